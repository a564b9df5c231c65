"""Sources of addresses and reference data."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X

SAMPLE = "text string, suggested string, has_suggested boolean, force boolean"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("text", F.lit("").alias("suggested"), F.lit(False).alias("has_suggested"), F.lit(False).alias("force"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row per line, empty ones too; a carriage return before the line feed goes."""
    return _plain(spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("text")))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", column: str = "address") -> DataFrame:
    """CSV or TSV with a header; rows without address are skipped, hints and force flags are read where present."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep, mode="PERMISSIVE")
    raw = raw.toDF(*[c.removeprefix("﻿").strip() for c in raw.columns])
    if column not in raw.columns:
        raise ValueError(f"Column '{column}' not found")
    get = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in raw.columns else F.lit("")
    hint = X.country_code(get("suggested_country"))
    return raw.where(F.col(f"`{column}`").isNotNull() & (F.col(f"`{column}`") != "")).select(F.col(f"`{column}`").alias("text"), hint.alias("suggested"), (hint != "").alias("has_suggested"), X.is_true(get("force_suggested_country")).alias("force"))


def property_text(properties: Column, names: Column, key: str) -> Column:
    """A property of a map to variants by name, whatever its case (``names`` are the sorted keys): strings and numbers as trimmed text, others empty."""

    def shown(value: Column) -> Column:
        other = X.let(F.schema_of_variant(value), lambda kind: kind.isin("BOOLEAN", "VOID") | F.regexp_like(kind, F.lit("^(OBJECT|ARRAY)")))
        return F.when(other, F.lit("")).otherwise(F.coalesce(F.trim(value.cast("string")), F.lit("")))

    return X.let(F.try_element_at(properties, F.get(F.filter(names, lambda k: F.lower(k) == key), F.lit(0))), shown)


def feature_text(number, street, unit, postcode, city, district, region) -> Column:
    """Address lines of a feature; nil-like lines and repeated ones (whatever their case) are left out."""
    joined = lambda *parts: F.concat_ws(" ", *[X.let(F.trim(p), lambda x: F.when(x != "", x)) for p in parts])
    lines = F.array(joined(number, street), joined(unit), joined(postcode, city), joined(district), joined(region))
    # one walk over the five lines keeps the first of equals
    kept = F.aggregate(lines, F.array().cast("array<string>"), lambda got, x: F.when(X.is_nil(x) | F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.concat(got, F.array(x))))
    return F.array_join(kept, "\n")


KEYS = ("number", "street", "unit", "postcode", "city", "district", "region")


#: What is read of a feature; ``__broken`` is set where a line is no JSON.
FEATURE = "properties map<string,variant>, __broken string"
#: The longest line that is read, in bytes.
LINE_BYTES = 10 << 20


def features(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``text`` to GeoJSON lines; broken JSON and overlong lines are errors (with the line's number where there is a column ``line``), blank lines and features without text go. Each line is parsed once."""
    rows = lines.where(F.trim(value) != "")
    where = F.concat(F.lit("line "), F.col("line"), F.lit(": ")) if "line" in lines.columns else F.lit("")
    fail = lambda what: F.raise_error(F.concat(where, F.lit(what), F.substring(F.col(value), 1, 80))).cast("string")
    text = F.when(F.octet_length(value) <= LINE_BYTES, F.col(value)).otherwise(fail("line is too long: "))
    # each step binds what the next ones read several times; the optimizer would put the whole expression in each place
    usable = lambda f: F.when(f["__broken"].isNull(), f["properties"]).otherwise(F.from_json(fail("bad JSON: "), "map<string,variant>"))
    shown = lambda props: X.let(F.array_sort(F.map_keys(props)), lambda names: feature_text(*[property_text(props, names, k) for k in KEYS]))
    made = X.let(F.from_json(text, FEATURE, {"columnNameOfCorruptRecord": "__broken"}), lambda f: X.let(usable(f), shown))
    # a filter isn't moved below a generator, so the text isn't made a second time for it
    return rows.withColumn("text", F.explode(F.array(made))).where("text <> ''")


def read_geojson(spark: SparkSession, path: str, country: str = "", most: int = 0) -> DataFrame:
    """Newline-delimited features; ``most`` limits accepted rows."""
    rows = features(spark.read.text(path, lineSep="\n")).select("text", F.lit(country.strip().upper()).alias("suggested"))
    rows = rows.withColumns({"has_suggested": F.col("suggested") != "", "force": F.lit(False)})
    return rows.limit(most) if most > 0 else rows


def read_directory(spark: SparkSession, path: str, countries: list[str] | None = None, most: int = 0) -> DataFrame:
    """All files named *addresses*.geojson below a folder, in order of path; the country is a two-letter folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[gG][eE][oO][jJ][sS][oO][nN]").text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"))
    raw = raw.where(F.regexp_like("path", F.lit(r"(?i)/[^/]*addresses[^/]*\.geojson$")))
    below = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    first = F.regexp_extract("path", path.rstrip("/").rsplit("/", 1)[-1] + r"/([A-Za-z]{2})/", 1)
    code = F.upper(F.when(F.length(below) == 2, below).otherwise(first))
    rows = raw.withColumn("suggested", code)
    if countries:
        rows = rows.where(F.col("suggested").isin(*[c.strip().upper() for c in countries]))
    rows = features(rows).select("text", "suggested", (F.col("suggested") != "").alias("has_suggested"), F.lit(False).alias("force"), "path")
    rows = rows.orderBy("path") if most > 0 else rows
    return (rows.limit(most) if most > 0 else rows).drop("path")


def read_addresses(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .txt, .csv, .tsv, .geojson; anything without a suffix is a folder of features."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(".txt"):
        return read_text(spark, path)
    if name.endswith((".csv", ".tsv")):
        return read_delimited(spark, path, "\t" if name.endswith(".tsv") else ",", **options)
    if name.endswith(".geojson"):
        return read_geojson(spark, path, **options)
    if "." not in name:
        return read_directory(spark, path, **options)
    raise ValueError(f"no reader for {path}")


def numbered(addresses: DataFrame) -> DataFrame:
    """Adds addr_id in order of reading."""
    return addresses.withColumn("addr_id", F.monotonically_increasing_id())


# ---------------------------------------------------------------- reference data


def read_zlib_json(spark: SparkSession, path: str):
    """The JSON value of a zlib stream; dictionaries of this kind are small and read on the driver through Spark."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return json.loads(zlib.decompress(content))


def read_json(spark: SparkSession, path: str):
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return json.loads(content)


def alias_rows(spark: SparkSession, aliases: dict[str, list[str]]) -> DataFrame:
    """(origin, name, ord) of a country-to-names dictionary."""
    rows = [(c, n, i) for c, names in aliases.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "origin string, name string, ord int")


def read_towns(spark: SparkSession, path: str) -> DataFrame:
    """(name, country, population, ord) of the towns table, whose country column has a space in its name."""
    raw = spark.read.parquet(path)
    return raw.select("name", F.col("`country code`").alias("country"), "population", F.monotonically_increasing_id().alias("ord"))


def read_specs(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    rows = [(c, s.get("domain_extensions") or [], s.get("phone_prefixes") or [], s.get("postal_code_regex") or "", bool(s.get("iban"))) for c, s in specs.items()]
    return spark.createDataFrame(rows, "origin string, domain_extensions array<string>, phone_prefixes array<string>, postal_code_regex string, iban boolean")


def read_crf(config: dict):
    """CRF parameters of a config; start and end may go by their longer names."""
    from ..operators.seqmodel import Crf

    return Crf(config.get("start") or config["start_transitions"], config.get("end") or config["end_transitions"], config["transitions"], config.get("transitions_order_2") or [])


def read_tags(values: list) -> list[tuple[str, str]]:
    """(bio, tag) of a tag list: objects or strings like B-TOWN; numbers and unknown tags are refused."""
    out = []
    for v in values:
        if isinstance(v, dict):
            bio, tag = str(v.get("bio", "")).rstrip("-"), v.get("tag", "")
        elif isinstance(v, str):
            bio, _, tag = v.partition("-") if v != "OTHER" else ("OTHER", "", "OTHER")
        else:
            raise ValueError(f"a tag is a name, not {v!r}")
        if bio not in ("B", "I", "OTHER") or tag not in S.TAGS:
            raise ValueError(f"unknown tag {v!r}")
        out.append((bio, tag))
    return out


def parse_request(body: str) -> list[str]:
    """The texts of a convert request: {"text": ...} or {"items": [{"text": ...}]}, nothing else."""
    value = json.loads(body)
    if not isinstance(value, dict) or set(value) - {"text", "items"} or ("text" in value) == ("items" in value):
        raise ValueError("give text or items")
    items = [{"text": value["text"]}] if "text" in value else value["items"]
    if not isinstance(items, list) or not items:
        raise ValueError("no items")
    for item in items:
        if not isinstance(item, dict) or set(item) != {"text"} or not isinstance(item["text"], str) or not item["text"].strip():
            raise ValueError("an item is a text that isn't blank")
    return [item["text"] for item in items]


def read_labelled(spark: SparkSession, url: str, table: str = "addresses", country: str = "", driver: str = "org.sqlite.JDBC") -> DataFrame:
    """Labelled addresses over JDBC where a driver is on the class path, or from Parquet."""
    rows = spark.read.parquet(url) if not url.startswith("jdbc:") else spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver).load()
    return rows.where(F.lower("country") == country.strip().lower()) if country else rows
