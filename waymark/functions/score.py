"""Logistic scores of flagged matches, Column to Column, and their DuckDB form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def has(flags: Column, name: str) -> Column:
    return F.array_contains(flags, name)


def _terms(side: str, flags: Column, dist: Column) -> list[Column]:
    weights = S.TOWN_WEIGHTS if side == "town" else S.COUNTRY_WEIGHTS
    terms = [F.when(has(flags, k), F.lit(w)).otherwise(0.0) for k, w in weights.items()]
    typo = F.when((dist > 0) & ~has(flags, "IS_SEPARATOR_TYPO"), dist * S.TYPO[side]).otherwise(0.0)
    terms += [typo, F.when(has(flags, "IS_SHORT") & (dist > 0), S.SHORT_TYPO).otherwise(0.0), F.when(has(flags, "IS_SHORT") & has(flags, "IS_INSIDE_ANOTHER_WORD"), S.SHORT_INSIDE).otherwise(0.0)]
    if side == "town":
        missing = ~has(flags, "COUNTRY_IS_PRESENT")
        # the missing-country term is positive: it raises the score
        terms += [F.when(missing & has(flags, "IS_SMALL_TOWN"), S.SMALL_WITHOUT_COUNTRY).otherwise(0.0), F.when(missing, S.COUNTRY_MISSING).otherwise(0.0)]
    return terms


def match_score(side: str, flags: Column, dist: Column, crf: Column) -> Column:
    """1 / (1 + exp(-(logit + (4 - 1.5c) bonus + (2.5 + 1.5c) malus))); a generated match keeps its own score."""
    terms = _terms(side, flags, dist)
    bonus = sum((F.greatest(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    malus = sum((F.least(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    c = F.least(F.greatest(crf, F.lit(1e-6)), F.lit(1 - 1e-6))
    a = F.least(F.greatest(c, F.lit(0.1)), F.lit(0.9))
    score = 1 / (1 + F.exp(-(F.log(a / (1 - a)) + (4 - 1.5 * c) * bonus + (2.5 + 1.5 * c) * malus)))
    return F.when(has(flags, "GENERATED_BY_SUGGESTED_COUNTRY"), crf).otherwise(score) if side == "country" else score


def match_score_sql(side: str, flags: str, dist: str, crf: str) -> str:
    weights = S.TOWN_WEIGHTS if side == "town" else S.COUNTRY_WEIGHTS
    h = lambda k: f"list_contains({flags}, '{k}')"
    terms = [f"case when {h(k)} then {w} else 0 end" for k, w in weights.items()]
    terms += [f"case when {dist} > 0 and not {h('IS_SEPARATOR_TYPO')} then {dist} * {S.TYPO[side]} else 0 end", f"case when {h('IS_SHORT')} and {dist} > 0 then {S.SHORT_TYPO} else 0 end", f"case when {h('IS_SHORT')} and {h('IS_INSIDE_ANOTHER_WORD')} then {S.SHORT_INSIDE} else 0 end"]
    if side == "town":
        missing = f"not {h('COUNTRY_IS_PRESENT')}"
        terms += [f"case when {missing} and {h('IS_SMALL_TOWN')} then {S.SMALL_WITHOUT_COUNTRY} else 0 end", f"case when {missing} then {S.COUNTRY_MISSING} else 0 end"]
    bonus, malus = " + ".join(f"greatest({t}, 0.0)" for t in terms), " + ".join(f"least({t}, 0.0)" for t in terms)
    c = f"least(greatest({crf}, 1e-6), 1 - 1e-6)"
    a = f"least(greatest({c}, 0.1), 0.9)"
    score = f"1 / (1 + exp(-(ln({a} / (1 - {a})) + (4 - 1.5 * {c}) * ({bonus}) + (2.5 + 1.5 * {c}) * ({malus}))))"
    return f"case when {h('GENERATED_BY_SUGGESTED_COUNTRY')} then {crf} else {score} end" if side == "country" else score


def solo_country(score: Column, flags: Column) -> Column:
    got = sum((F.when(has(flags, k), S.COUNTRY_WEIGHTS[k]).otherwise(0.0) for k in ("TOWN_IS_PRESENT", "IS_VERY_CLOSE_TO_TOWN", "IS_ON_SAME_LINE_AS_TOWN")), F.lit(0.0))
    return (score + 0.15 - 0.7 * got) / 2


def solo_town(score: Column, flags: Column) -> Column:
    got = sum((F.when(has(flags, k), S.TOWN_WEIGHTS[k]).otherwise(0.0) for k in ("COUNTRY_IS_PRESENT", "SUGGESTED_COUNTRY_IS_PRESENT", "IS_VERY_CLOSE_TO_COUNTRY", "IS_ON_SAME_LINE_AS_COUNTRY")), F.lit(0.0))
    return (0.15 + score - 0.1 * got) / 2


def quality(country: Column, town: Column, country_score: Column, town_score: Column, high: float = 0.0, medium: float = 0.0) -> Column:
    """(status, band, reason) of a resolved row; empty names are missing."""
    high, medium = S.thresholds(high, medium)
    made = lambda s, b, r: F.struct(F.lit(s).alias("status"), F.lit(b).alias("band"), F.lit(r).alias("reason"))
    has_c, has_t = F.coalesce(country, F.lit("")) != "", F.coalesce(town, F.lit("")) != ""
    low = F.least(F.coalesce(country_score, F.lit(0.0)), F.coalesce(town_score, F.lit(0.0)))
    one = F.when(has_c, F.coalesce(country_score, F.lit(0.0))).otherwise(F.coalesce(town_score, F.lit(0.0)))
    gap = F.when(has_c, F.lit("missing_town")).otherwise(F.lit("missing_country"))
    partial = lambda b: F.struct(F.lit("partial").alias("status"), F.lit(b).alias("band"), gap.alias("reason"))
    return (
        F.when(has_c & has_t & (low >= high), made("resolved", "high", "high_confidence"))
        .when(has_c & has_t & (low >= medium), made("needs_review", "medium", "confidence_below_high"))
        .when(has_c & has_t, made("needs_review", "low", "low_confidence"))
        .when((has_c | has_t) & (one >= medium), partial("medium"))
        .when(has_c | has_t, partial("low"))
        .otherwise(made("needs_review", "low", "missing_country"))
    )
