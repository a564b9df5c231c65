"""Reference dictionaries as DataFrames: country aliases, town indexes, their aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def alias_origins(names: DataFrame) -> DataFrame:
    """(alias, origins) of (origin, name): every writing of every name, with its sorted distinct origins."""
    made = names.select(F.upper(F.trim("origin")).alias("origin"), F.explode(X.aliases(X.lookup_name(F.col("name")))).alias("alias")).where("alias <> ''")
    return made.groupBy("alias").agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def alpha2_names(names: DataFrame) -> DataFrame:
    """(origin, name): the first alias listed for a country; needs a column ``ord``."""
    return names.groupBy(F.upper(F.trim("origin")).alias("origin")).agg(F.min_by("name", "ord").alias("name"))


def town_aliases(towns: DataFrame) -> DataFrame:
    """(alias, country, population, ord) of (name, country, population, ord); rows without name or country go."""
    rows = towns.where((F.trim("name") != "") & (F.trim("country") != ""))
    return rows.select(F.explode(X.aliases(X.lookup_name(F.col("name")))).alias("alias"), X.country_code(F.col("country")).alias("country"), F.col("population").cast("long").alias("population"), "ord").where("alias <> ''")


def with_aliases(towns: DataFrame, listed: DataFrame) -> DataFrame:
    """towns and a row more for each listed alias (origin: the town's name, name: the alias) of a town."""
    names = listed.select(X.lookup_name(F.col("origin")).alias("__key"), F.col("name").alias("__alias"))
    more = towns.withColumn("__key", X.lookup_name(F.col("name"))).join(names, "__key").select(F.col("__alias").alias("name"), "country", "population", "ord")
    return towns.select("name", "country", "population", "ord").unionByName(more)


def town_index(towns: DataFrame) -> DataFrame:
    """(alias, population, largest): the greatest population of an alias and the country that has it, the first row winning ties. Populations of 0 aren't recorded."""
    rows = town_aliases(towns).where("population > 0")
    return rows.groupBy("alias").agg(F.max("population").alias("population"), F.max_by("country", F.struct(F.col("population"), (-F.col("ord")).alias("o"))).alias("largest"))


def town_origins(towns: DataFrame) -> DataFrame:
    return town_aliases(towns).groupBy("alias").agg(F.array_sort(F.collect_set("country")).alias("origins"))


def code_candidates(alpha2: DataFrame, origins: DataFrame) -> DataFrame:
    """(possibility, origins): two-letter codes, of the keys and of all origins."""
    codes = alpha2.select("origin").union(origins.select(F.explode("origins").alias("origin"))).where("origin <> ''").distinct()
    return codes.select(F.col("origin").alias("possibility"), F.array("origin").alias("origins"))


@dataclass
class ReferenceData:
    """The dictionaries a resolver needs. Optional ones are None."""

    countries: DataFrame  # possibility, origins
    codes: DataFrame  # possibility, origins
    towns: DataFrame  # possibility, origins
    town_index: DataFrame  # alias, population, largest
    extended_towns: DataFrame | None = None  # possibility, origins
    same_name: DataFrame | None = None  # possibility, origin
    provinces: DataFrame | None = None  # origin, alias
    specs: DataFrame | None = None  # origin, domain_extensions, phone_prefixes, postal_code_regex
    postcodes: DataFrame | None = None  # origin, code, town, regex, suffix

    @classmethod
    def build(cls, countries: DataFrame, towns: DataFrame, **optional) -> ReferenceData:
        """From (origin, name) of countries and (name, country, population, ord) of towns; provinces' names are aliases of their countries. "NO COUNTRY" becomes an alias without origin by its own placeholder rows in the resolver."""
        origins = alias_origins(countries.select("origin", "name").union(optional["provinces"].select("origin", F.col("alias").alias("name"))) if optional.get("provinces") is not None else countries)
        return cls(origins.withColumnRenamed("alias", "possibility"), code_candidates(countries.select(F.upper(F.trim("origin")).alias("origin")).distinct(), origins), town_origins(towns).withColumnRenamed("alias", "possibility"), town_index(towns), **optional)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, *, names: dict[str, str] | None = None) -> ReferenceData:
        """From a folder of resources (``FILES``, whose names can be replaced): country and province aliases and specs as zlib JSON, same names as JSON, towns as Parquet. Paths may be absolute. The postal codes of the data model aren't part of a folder."""
        from ..sources import readers as R

        at = {k: resolve_path(folder, v) for k, v in (FILES | (names or {})).items()}
        provinces = R.alias_rows(spark, R.read_zlib_json(spark, at["provinces"])).select("origin", F.col("name").alias("alias"))
        same = R.read_json(spark, at["same_name"])
        same_name = spark.createDataFrame([(_upper(k), _upper(v)) for k, v in same.items()], "possibility string, origin string")
        specs = R.read_specs(spark, R.read_zlib_json(spark, at["specs"]))
        towns = with_aliases(R.read_towns(spark, at["towns"]), R.alias_rows(spark, R.read_zlib_json(spark, at["town_aliases"])))
        return cls.build(R.alias_rows(spark, R.read_zlib_json(spark, at["countries"])), towns, provinces=provinces, specs=specs, same_name=same_name)


#: The files of a resources folder, fixed values.
FILES = {"countries": "country_names.json", "provinces": "country_province_names.json", "specs": "misc/country_specs.json", "same_name": "misc/country_city_same_name.json", "towns": "towns_all_countries.parquet", "town_aliases": "town_aliases.json"}


def _upper(name: str) -> str:
    return name.strip().upper()


def resolve_path(folder: str, path: str) -> str:
    """An absolute path or address as it is, others below the folder."""
    return path if path.startswith("/") or "://" in path else f"{folder.rstrip('/')}/{path}"
