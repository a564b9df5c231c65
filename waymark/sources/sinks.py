"""Sinks: human-readable tables, JSON, review and mismatch rows, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def percent(score: Column) -> Column:
    """A share as a percentage with two decimals, rounded from the exact binary value as printf does.

    The percentage is taken apart into a multiple of 2^-20 and the rest, so that its 200-fold, which is compared
    with the odd numbers between two results, is exact in both parts.
    """
    x = score * 100
    high = F.floor(x * F.lit(2.0**20)) / F.lit(2.0**20)
    low, cents = x - high, F.floor(x * 100)
    gap = (200 * high - (2 * cents + 1)) + 0.0
    side = -200 * low
    n = cents + F.when((gap > side) | ((gap == side) & (cents % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("%"))


def readable(combos: DataFrame, addresses: DataFrame, n: int = 2, inferred: DataFrame | None = None) -> DataFrame:
    """Base columns, then for each of the n best combinations what was matched, its confidence and what it stands for, of country and town; ``inferred`` (addr_id, code) adds a column of inferred countries."""
    hinted = F.col("suggested") != ""
    rows = addresses.select("addr_id", F.col("text").alias("address"), F.when(hinted, F.col("suggested")).otherwise("").alias("suggested_country"), F.when(hinted, F.col("force").cast("string")).otherwise("").alias("force_suggested_country"))
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(""))
    shown = {"country": flat("country_matched"), "country_confidence": percent(F.col("country_score")), "country_resolved_code": F.col("country"), "town": flat("town_matched"), "town_confidence": percent(F.col("town_score")), "town_resolved": F.col("town")}
    aggs = [F.coalesce(F.max(F.when(F.col("number") == i, c)), F.lit("")).alias(f"{i}th_best_{name}") for i in range(1, n + 1) for name, c in shown.items()]
    rows = rows.join(combos.groupBy("addr_id").agg(*aggs), "addr_id", "left")
    if inferred is not None:
        codes = inferred.select("addr_id", F.col("code").alias("__code"))
        rows = rows.join(codes, "addr_id", "left").withColumns({f"{i}th_inferred_country_resolved_code": F.coalesce("__code", F.lit("")) for i in range(1, n + 1)}).drop("__code")
    return rows


def verbose(rows: DataFrame, predictions: DataFrame, countries: DataFrame | None = None, towns: DataFrame | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Adds columns of JSON: the lists of matches, the country head and spans (``tagged``: addr_id, text, head, spans), IBANs, and the predictions of each tag that occurs (a bounded set) or is one of the three main ones.

    predictions: (addr_id, tag, text, confidence). Without a head the text says so.
    """
    for name, found in (("country", countries), ("town", towns)):
        if found is not None:
            listed = found.groupBy("addr_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("start", "stop", "matched", "possibility", "origin", "dist", "flags", "crf", "score").alias("m")))), lambda x: x["m"])).alias(f"detailed_{name}_matches"))
            rows = rows.join(listed, "addr_id", "left")
    if tagged is not None:
        off = "Country head disabled"
        known = F.coalesce(F.col("head.country") != "", F.lit(False))
        rows = rows.join(tagged.select("addr_id", F.when(known, F.col("head.country")).otherwise(off).alias("country_head_prediction"), F.when(known, percent(F.col("head.confidence"))).otherwise(off).alias("country_head_confidence"), F.to_json("spans").alias("crf_spans"), F.array_join(X.ibans(F.col("text")), "\n").alias("ibans")), "addr_id", "left")
    seen = {r[0] for r in predictions.select("tag").distinct().collect()} | {"COUNTRY", "TOWN", "POSTAL_CODE"}
    each = [F.to_json(F.collect_list(F.when(F.col("tag") == t, F.struct("text", "confidence")))).alias(f"crf_prediction_{t.lower()}") for t in S.TAGS if t in seen]
    return rows.join(predictions.groupBy("addr_id").agg(*each), "addr_id", "left")


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.csv(path, header=True, sep=sep, quoteAll=False, escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def response(items: DataFrame) -> DataFrame:
    """One JSON text {"items": [...]} of a request's items, in order of ``item``. A request is small."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item", F.struct(*[c for c in items.columns if c != "item"]).alias("v")))), lambda x: x["v"])
    return items.agg(F.to_json(F.struct(ordered.alias("items"))).alias("body"))


def error(code: str, message: str) -> tuple[int, dict]:
    """HTTP status and body of an error."""
    status = {"method_not_allowed": 405, "invalid_request": 400}.get(code, 500)
    return status, {"error": {"code": code, "message": message}}


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda v: v.cast("string")), ","), F.lit("]"))
