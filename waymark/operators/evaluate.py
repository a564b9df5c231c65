"""Evaluation: groups and strata of labelled addresses, stratified samples, accuracy by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def groups(labelled: DataFrame, *, blank_towns: bool = False) -> DataFrame:
    """(country, town, n, stratum): counts by country and town; common from 1000 rows on, medium from 100."""
    rows = labelled if blank_towns else labelled.where(F.trim("town") != "")
    n = F.count(F.lit(1))
    return rows.groupBy("country", "town").agg(n.cast("long").alias("n")).withColumn("stratum", stratum(F.col("country"), F.col("n")))


def stratum(country, n):
    return F.concat(F.upper(country), F.lit(":"), F.when(n >= 1000, "common").when(n >= 100, "medium").otherwise("rare"))


def allocation(grouped: DataFrame, limit: int) -> DataFrame:
    """(stratum, draws): the limit in equal parts, the first strata in order taking one more each."""
    strata = grouped.groupBy("stratum").agg(F.count(F.lit(1)).alias("groups"))
    # a row a stratum: numbering them in one task is bounded by countries times three
    nth, n = F.row_number().over(W.orderBy("stratum")), F.count(F.lit(1)).over(W.partitionBy())
    return strata.select("stratum", "groups", (F.floor(F.lit(limit) / n) + F.when(nth <= F.lit(limit) % n, 1).otherwise(0)).cast("long").alias("draws"))


def plan(grouped: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """(stratum, draw, country, town, offset): for each draw a group of the stratum, with replacement, and a row of it, by two independent hashes of seed, stratum and draw."""
    numbered = grouped.withColumn("g", F.row_number().over(W.partitionBy("stratum").orderBy("country", "town")) - 1)
    draws = allocation(grouped, limit).where("draws > 0").select("stratum", "groups", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("draw"))
    h = lambda what: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(f"{seed}/{what}"), "stratum", F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    picked = draws.withColumn("g", (h("group") % F.col("groups")).cast("int")).withColumn("h", h("row"))
    return picked.join(numbered, ["stratum", "g"]).select("stratum", "draw", "country", "town", (F.col("h") % F.col("n")).alias("offset"))


def fetch(planned: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled rows that the plan draws, each id once: the row at an offset of its group by id."""
    at = labelled.withColumn("offset", (F.row_number().over(W.partitionBy("country", "town").orderBy("id")) - 1).cast("long"))
    return at.join(planned.select("country", "town", "offset", "stratum").distinct(), ["country", "town", "offset"])


def input_text(mode: str = "address-town"):
    """What the resolver is given: address, address-town (also for unknown modes) or address-town-country; blank parts are left out."""
    parts = {"address": ["address"], "address-town-country": ["address", "town", "country"]}.get(mode, ["address", "town"])
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", F.col(p)) for p in parts])


def correct(rows: DataFrame) -> DataFrame:
    """Adds country_ok and town_ok by canonical names."""
    return rows.withColumns({"country_ok": X.country_code(F.col("expected_country")) == X.country_code(F.col("actual_country")), "town_ok": X.canonical_town(F.col("expected_town")) == X.canonical_town(F.col("actual_town"))})


def accuracy(rows: DataFrame) -> DataFrame:
    """Counts and rates of correct rows for each stratum and, with a null stratum, for all: one pass with grouping sets."""
    got = correct(rows)
    return got.groupingSets([["stratum"], []], "stratum").agg(F.count(F.lit(1)).alias("total"), F.count_if("country_ok").alias("country_correct"), F.count_if("town_ok").alias("town_correct"), F.count_if(F.col("country_ok") & F.col("town_ok")).alias("both_correct")).withColumns({f"{k}_rate": F.round(F.col(f"{k}_correct") / F.col("total"), 6) for k in ("country", "town", "both")})


def mismatches(rows: DataFrame) -> DataFrame:
    return correct(rows).where(~(F.col("country_ok") & F.col("town_ok"))).drop("country_ok", "town_ok")
