"""Quality rules: base statistics of whole texts and robust multivariate outliers.

Statistics (``text_stats``) are exact counts over whole texts. The verdict comes from a minimum
covariance determinant (MCD) estimate of location and scatter per language and source: concentration
steps over *all* rows of each group, every group at once, as grouped aggregates. Each step keeps, per
group, the ``coverage`` share of rows of least Mahalanobis distance (the share's distance is read from
a histogram of fixed, logarithmic bins, so no group is sorted or collected) and estimates again from
those rows. The starting scatter is the diagonal of squared normalised interquartile-like spreads from
per-dimension histograms, a deterministic start, so results do not depend on partitioning.

Documents with ``base_failed`` neither enter the estimates nor are kept. Groups with fewer than
``least`` rows borrow the estimate of their language, and languages with fewer that of all rows.

Edge cases: null or empty text has no words and so fails the base; null lang or source form groups of
their own; repeated rows count as often as they occur; extra columns pass through ``filter_quality``
unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Dimensions of the transformed vector.
DIMS = ("x0", "x1", "x2", "x3", "x4")
#: The least spread in each dimension: what is finer than this is no oddity. In the units of transformed().
FLOOR = (0.25, 0.06, 0.05, 0.05, 0.05)


def block_stats(text: pa.Array) -> dict[str, np.ndarray]:
    """The five base statistics of each row."""
    data, offsets = common.flat_text(text)
    words = common.Words(data, offsets)
    n, rows = len(words), len(offsets) - 1
    point = words.solid & ((data & 0xC0) != 0x80)
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": common.sums(point, offsets),
        "n_symbols": common.sums(SYMBOLS[data], offsets),
    }
    # lines: cut at every \n and at row ends; exact codes of the lines that hold a word
    cut = data == 0x0A
    kept = data.take(np.flatnonzero(~cut))
    before = np.concatenate([[0], np.cumsum(~cut)])  # kept bytes before each place
    edges = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets]))
    line_ends = before[edges]
    lines = common.to_array(kept, line_ends)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row_of = np.searchsorted(offsets, edges[:-1], "right") - 1
    solid = common.sums(words.solid, edges) > 0
    codes, row_of = codes[solid], row_of[solid]
    if len(codes):
        pairs = row_of * (int(codes.max()) + 1) + codes
        first = np.unique(pairs, return_index=True)[1]
        again = np.ones(len(pairs), np.int64)
        again[first] = 0
        out["n_dup_lines"] = np.bincount(row_of, again, rows).astype(np.int64)
    else:
        out["n_dup_lines"] = np.zeros(rows, np.int64)
    # windows of three words; a window's code is exact: codes of pairs of codes
    covered = np.zeros(n, bool)
    if n >= 3:
        word, _ = words.codes()
        word = word.astype(np.int64)
        pair, size = common.codes_of(word[:-1] * (int(word.max()) + 1) + word[1:])
        three, size = common.codes_of(pair[:-1].astype(np.int64) * (int(word.max()) + 1) + word[2:])
        row = words.row()
        inside = np.flatnonzero(row[2:] == row[:-2])
        keys, _ = common.codes_of(row[inside] * size + three[inside])
        many = inside[np.bincount(keys)[keys] >= 2] if len(keys) else inside
        for k in range(3):
            covered[many + k] = True
    out["n_repeat_words"] = common.sums(covered, words.first)
    return out


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the five statistics (which replace columns of their names)."""
    common.ship(docs.sparkSession)
    names = [f.split()[0] for f in STATS.split(", ")]
    carried = [c for c in docs.columns if c != text and c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    schema = source.drop("__text").schema
    for part in STATS.split(", "):
        schema = schema.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text"):
            stats = block_stats(block.column(block.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *[pa.array(stats[n], pa.int64()) for n in names]], names=[*carried, *names])

    return source.mapInArrow(common.tidy(run), schema)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list:
    """The vector: log length, mean word length, square roots of the shares of symbols and repeated lines, and the share of repeated windows.

    That share's root is far heavier-tailed: chance alone repeats a few windows of a short text.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")).alias("x0"),
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.5))).alias("x1"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x3"),
        (F.col("n_repeat_words") / n).alias("x4"),
    ]


#: Histogram bins: a dimension's bin is 1/128, a squared distance's bin a 32nd of an octave.
GRID, OCTAVE = 128.0, 32.0


def _quantile_bins(counted: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """From (keys, bin, n): per key the smallest bin at or below which each share of the rows lies. Grids are bounded, so a key has few bins."""
    bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
    total = F.sum("n")
    got = counted.groupBy(*keys).agg(bins.alias("bins"), total.alias("total"))

    def at(share: float):
        walked = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.when(a["bin"].isNotNull(), a["bin"]).when((a["seen"] + x["n"]) >= F.ceil(F.col("total") * share), x["bin"]).alias("bin"),
            ),
        )
        return walked["bin"]

    return got.select(*keys, "total", *[at(v).alias(k) for k, v in shares.items()])


def _solve(schema_keys: list[str]):
    """(keys, n, sums, products) to (keys, n, mean, inverse scatter, log determinant), a row per group."""
    d = len(DIMS)

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            mean, inverse, logdet = [], [], []
            for i in range(batch.num_rows):
                n = max(1, cols["n"][i])
                m = np.array([cols[f"s{a}"][i] for a in range(d)]) / n
                c = np.empty((d, d))
                for a in range(d):
                    for b in range(a, d):
                        c[a, b] = c[b, a] = cols[f"p{a}{b}"][i] / n - m[a] * m[b]
                c += np.diag(np.square(FLOOR))
                mean.append([round(float(v), 9) for v in m])
                inverse.append([round(float(v), 9) for v in np.linalg.inv(c).ravel()])
                logdet.append(round(float(np.linalg.slogdet(c)[1]), 9))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in schema_keys] + [pa.array(cols["n"], pa.int64()), pa.array(mean, pa.list_(pa.float64())), pa.array(inverse, pa.list_(pa.float64())), pa.array(logdet, pa.float64())], names=[*schema_keys, "n", "mean", "inverse", "logdet"])

    return run


def _moments(rows: DataFrame, level: str) -> DataFrame:
    d = len(DIMS)
    # sums of fixed-point values are exact, so neither partitioning nor order shows in the results
    fixed = lambda c: F.sum(F.round(c * F.lit(1e6)).cast("long")) / F.lit(1e6)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [fixed(F.col(f"x{a}")).alias(f"s{a}") for a in range(d)]
    aggs += [fixed(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}{b}") for a in range(d) for b in range(a, d)]
    return rows.groupBy(level).agg(*aggs).mapInArrow(common.tidy(_solve([level])), f"{level} string, n long, mean array<double>, inverse array<double>, logdet double")


def _distance():
    d = len(DIMS)
    gap = [F.col(f"x{a}") - F.element_at("mean", a + 1) for a in range(d)]
    total = F.lit(0.0)
    for a in range(d):
        for b in range(d):
            total = total + gap[a] * gap[b] * F.element_at("inverse", a * d + b + 1)
    return F.greatest(total, F.lit(0.0))


def _bin(distance):
    return F.floor(F.log2(distance + F.lit(2.0**-20)) * OCTAVE).cast("long")


def mcd(rows: DataFrame, level: str, coverage: float, steps: int) -> DataFrame:
    """MCD estimates per value of ``level`` over rows of x0..x4: (level, n, mean, inverse, scale)."""
    spark = rows.sparkSession
    d = len(DIMS)
    # start: medians and interquartile spreads from histograms
    long = rows.select(level, F.explode(F.array(*[F.struct(F.lit(a).alias("dim"), F.floor(F.col(f"x{a}") * GRID).cast("long").alias("bin")) for a in range(d)])).alias("v"))
    counted = long.groupBy(level, F.col("v.dim").alias("dim"), F.col("v.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = _quantile_bins(counted, [level, "dim"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    spread = spread.select(level, "dim", "total", ((F.col("q2") + 0.5) / GRID).alias("mid"), F.pow((F.col("q3") - F.col("q1") + 1) / GRID / 1.349, 2).alias("var"))
    floor = F.element_at(F.array(*[F.lit(f * f) for f in FLOOR]), F.col("dim") + 1)
    start = spread.groupBy(level).agg(F.max("total").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "mid"))), lambda v: v["mid"]).alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.lit(1.0) / (F.col("var") + floor)).alias("w")))), lambda v: v["w"]).alias("w"))
    inverse = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda b: F.when(a == b, F.element_at("w", a + 1)).otherwise(F.lit(0.0)))))
    fit = common.settle(start.select(level, "n", "mean", inverse.alias("inverse"), F.lit(None).cast("double").alias("logdet")), "mcd-start")
    for step in range(steps + 1):
        near = common.join_checked(rows, fit.select(level, "mean", "inverse"), [level]).withColumn("bin", _bin(_distance()))
        cut = _quantile_bins(near.groupBy(level, "bin").agg(F.count(F.lit(1)).alias("n")), [level], {"cut": coverage})
        if step == steps:
            break
        cut = common.settle(cut.select(level, "cut"), "mcd-cut")
        half = common.join_checked(near, cut, [level]).where(F.col("bin") <= F.col("cut"))
        new = common.settle(_moments(half, level), "mcd-step")
        common.remove(spark, cut.settled_at)
        common.remove(spark, fit.settled_at)
        fit = new
    # consistency: the covered share's distance should be the chi-square quantile of that share
    scale = F.pow(F.lit(2.0), (F.col("cut") + 1) / OCTAVE) / F.lit(chi2_quantile(coverage, d))
    out = fit.select(level, "mean", "inverse").join(cut.select(level, "total", scale.alias("scale")), level)
    return common.settle(out.select(level, F.col("total").alias("n"), "mean", "inverse", F.greatest("scale", F.lit(1.0)).alias("scale")), "mcd-fit")


def chi2_quantile(share: float, df: int) -> float:
    """Quantile of the chi-square distribution by bisection on its series."""

    def cdf(x: float) -> float:
        a, x = df / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-14:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < share else (low, mid)
    return (low + high) / 2


#: The squared robust distance that a good document exceeds with probability 0.001 under the normal model, 20.5.
CUTOFF = chi2_quantile(0.999, len(DIMS))


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text", coverage: float = 0.75, steps: int = 3, least: int = 60, cutoff: float = CUTOFF) -> DataFrame:
    """A row per row of docs: doc_id, the statistics, base_failed, distance2 and kept.

    ``cutoff`` is the squared robust distance above which a document is rejected. Real statistics have heavier
    tails than the normal model, so somewhat more than a thousandth of the good ones is lost (README).
    """
    common.ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.concat(F.lit("b"), F.to_json(F.struct(F.col(f"`{lang}`").alias("l"), F.col(f"`{source}`").alias("s")))).alias("g_both"), F.concat(F.lit("l"), F.to_json(F.struct(F.col(f"`{lang}`").alias("l")))).alias("g_lang"), F.lit("a").alias("g_all"), F.col(f"`{text}`").alias("text"))
    stats = common.settle(text_stats(slim).withColumn("base_failed", base_failed()), "stats").select("*", *transformed())
    # the three levels at once: a slim row for each level, so that each step is one job
    rows = stats.where(~F.col("base_failed")).select(F.explode(F.array("g_both", "g_lang", "g_all")).alias("g"), *DIMS)
    fit = mcd(rows, "g", coverage, steps)
    judged = stats
    for level in ("g_both", "g_lang", "g_all"):
        judged = common.join_checked(judged, fit.withColumnRenamed("g", level), [level], "left")
        judged = judged.withColumn(f"d_{level}", F.when(F.col("n") >= least, _distance() / F.col("scale"))).drop("n", "mean", "inverse", "scale")
    distance = F.coalesce("d_g_both", "d_g_lang", "d_g_all", F.lit(0.0))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round(distance, 4).alias("distance2"), (~F.col("base_failed") & (distance <= cutoff)).alias("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
