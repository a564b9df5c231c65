"""Postal codes: pattern hits in prepared texts, joined with a dictionary of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def match_postcodes(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(addr_id, start, stop, matched, possibility, origin) of texts (addr_id, text).

    dictionary: (origin, code, town, regex, suffix); a hit is a whole word of the pattern, with the
    suffix behind it where there is one; its key is the part the pattern alone matches. ``possibility`` is
    the town. Regexes are a row a country, so the join with them is small; keys are equi-joined.
    """
    patterns = dictionary.select("origin", "regex", F.coalesce("suffix", F.lit("")).alias("suffix")).distinct()
    prepared = texts.select("addr_id", "text", X.postcode_prepared(F.col("text")).alias("ready"))
    whole = F.concat(F.lit("\\b((?:"), F.col("regex"), F.lit(")"), F.col("suffix"), F.lit(")\\b"))
    hits = prepared.join(F.broadcast(patterns), F.regexp_like("ready", whole)).select("addr_id", "text", "ready", "origin", "regex", "suffix", F.explode(F.array_distinct(F.regexp_extract_all("ready", whole, F.lit(1)))).alias("hit"))
    key = F.when(F.col("suffix") == "", F.col("hit")).otherwise(F.regexp_replace("hit", F.concat(F.col("suffix"), F.lit("$")), F.lit("")))
    hits = hits.withColumn("key", key)
    starts = F.filter(F.sequence(F.lit(0), F.length("ready") - F.length("hit")), lambda i: (F.substring(F.col("ready"), i + 1, F.length("hit")) == F.col("hit")) & ~F.regexp_like(F.substring(F.col("ready"), i, F.when(i > 0, 1).otherwise(0)), F.lit("[A-Z0-9]")) & ~F.regexp_like(F.substring(F.col("ready"), i + 1 + F.length("hit"), F.lit(1)), F.lit("[A-Z0-9]")))
    placed = hits.withColumn("start", F.explode(starts))
    keyed = dictionary.select("origin", X.postcode_prepared(F.upper("code")).alias("key"), F.col("town").alias("possibility")).distinct()
    stop = F.col("start") + F.length("hit")
    return placed.join(keyed, ["origin", "key"]).select("addr_id", "start", stop.alias("stop"), X.at(F.col("text"), F.col("start"), F.length("hit")).alias("matched"), "possibility", "origin")
