"""Offline cache filling: decisions, constrained adjudication, review rows and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def cacheable(country: Column, town: Column, c_score: Column, t_score: Column, least: float) -> Column:
    return F.lit(True) if least <= 0 else (country != "") & (town != "") & (c_score >= least) & (t_score >= least)


def review_reason(country: Column, town: Column, c_score: Column, t_score: Column, otherwise: Column, least: float = S.LIMITS.review) -> Column:
    return F.when(country == "", "missing_country").when(town == "", "missing_town").when((c_score < least) | (t_score < least), "low_confidence").otherwise(otherwise)


def valid_decision(resolved: Column, country: Column, town: Column, countries: Column, towns: Column) -> Column:
    """A decision is valid if it is resolved, names both, and both stand among the candidates; case doesn't count."""
    c, t = F.upper(F.trim(country)), F.upper(F.trim(town))
    in_countries = F.exists(countries, lambda x: F.upper(F.trim(x["code"])) == c)
    in_towns = F.exists(towns, lambda x: (F.upper(F.trim(x["name"])) == t) & (F.upper(F.trim(x["country_code"])) == c))
    return F.coalesce(resolved & (c != "") & (t != "") & in_countries & in_towns, F.lit(False))


def candidates(combos: DataFrame, most: int = 5) -> DataFrame:
    """(addr_id, countries, towns): the first real candidates in list order, for a judge."""
    listed = lambda ok, s: F.slice(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("number", s.alias("v"))))), lambda x: x["v"]), 1, most)
    return combos.groupBy("addr_id").agg(listed((F.col("country") != S.NO_COUNTRY) & (F.col("country") != ""), F.struct(F.col("country").alias("code"), F.col("country_score").alias("score"))).alias("countries"), listed((F.col("town") != S.NO_TOWN) & (F.col("town") != ""), F.struct(F.col("town").alias("name"), F.col("town_origin").alias("country_code"), F.col("town_score").alias("score"))).alias("towns"))


def decide(resolved: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Adds ``action`` (cache, review), ``source`` and ``review`` to resolved rows (with ``band``, ``reason``).

    High quality is cached as crf_pipeline. Else a judge's recorded decision (addr_id, resolved, judge_country,
    judge_town, countries, towns) is cached as llm_assisted if valid, and reviewed as judge_unresolved if not.
    """
    high = F.col("band") == "high"
    why = review_reason(F.col("country"), F.col("town"), F.col("country_confidence"), F.col("town_confidence"), F.col("reason"))
    if decisions is None:
        return resolved.withColumns({"action": F.when(high, "cache").otherwise("review"), "source": F.when(high, "crf_pipeline"), "review": F.when(~high, why)})
    rows = resolved.join(decisions, "addr_id", "left")
    ok = valid_decision(F.col("resolved"), F.col("judge_country"), F.col("judge_town"), F.col("countries"), F.col("towns"))
    score_c = F.get(F.filter("countries", lambda x: F.upper(F.trim(x["code"])) == F.upper(F.trim("judge_country"))), F.lit(0))["score"]
    score_t = F.get(F.filter("towns", lambda x: (F.upper(F.trim(x["name"])) == F.upper(F.trim("judge_town"))) & (F.upper(F.trim(x["country_code"])) == F.upper(F.trim("judge_country")))), F.lit(0))["score"]
    use = ~high & ok
    return rows.withColumns({
        "action": F.when(high | ok, "cache").otherwise("review"),
        "source": F.when(high, "crf_pipeline").when(ok, "llm_assisted"),
        "review": F.when(~high & ~ok, F.when(F.col("resolved").isNotNull(), "judge_unresolved").otherwise(why)),
        "country": F.when(use, F.upper(F.trim("judge_country"))).otherwise(F.col("country")),
        "town": F.when(use, F.upper(F.trim("judge_town"))).otherwise(F.col("town")),
        "country_confidence": F.when(use, score_c).otherwise(F.col("country_confidence")),
        "town_confidence": F.when(use, score_t).otherwise(F.col("town_confidence")),
    }).drop("resolved", "judge_country", "judge_town", "countries", "towns")


def raw_text(decided: DataFrame) -> Column:
    """What was read, where it is known; else the cleaned line."""
    return F.col("input" if "input" in decided.columns else "address_line")


def cache_rows(decided: DataFrame, least: float = 0.0) -> DataFrame:
    ok = (F.col("action") == "cache") & cacheable(F.col("country"), F.col("town"), F.col("country_confidence"), F.col("town_confidence"), least)
    raw = raw_text(decided)
    return decided.where(ok).select(raw.alias("raw_address"), X.normalize_address(raw).alias("normalized_address"), "source", F.col("country").alias("country_code"), "town", "postal_code", "street")


def review_rows(decided: DataFrame) -> DataFrame:
    return decided.where("action = 'review'").select(raw_text(decided).alias("input"), "country", "town", "country_confidence", "town_confidence", F.col("review").alias("reason"))


def summary(decided: DataFrame, least: float = 0.0) -> DataFrame:
    """Counts of processed, cached, reviewed and skipped rows; what goes to review is what is skipped."""
    to_cache = (F.col("action") == "cache") & cacheable(F.col("country"), F.col("town"), F.col("country_confidence"), F.col("town_confidence"), least)
    review = F.count_if(F.col("action") == "review")
    return decided.agg(F.count(F.lit(1)).alias("processed"), F.count_if(to_cache).alias("cached"), review.alias("review"), review.alias("skipped"))
