"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The rows sit in source partitions. How many rows each partition sends to each shard is drawn first, as a
matrix whose rows sum to the partitions' counts and whose columns to the shards' sizes: row after row
from the multivariate hypergeometric distribution, which is the law of a uniform permutation. Then each
partition is permuted locally and dealt out by its row of the matrix, rows are exchanged, and each shard
is permuted again. Only DataFrame functions touch rows; the driver draws the matrix, whose size is
bounded by ``parts`` times the number of shards.

A permutation is a ranking by a seeded hash. A partition or a shard is ranked in ``ranges`` of the hash's
values, whose counts give the ranks' offsets, so no window holds a whole partition or shard.

Law ``rows``: shard sizes differ by one at most. Edge cases: a null text counts 16 bytes and has the
checksum of the empty text; null and repeated ids and repeated rows are placed like any other row (equal
rows are interchangeable); extra columns may be carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def draw_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Partition-to-shard counts: rows sum to ``counts``, columns to sizes at most one apart."""
    total = sum(counts)
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = []
    for n in counts:
        row, rest, need = np.zeros(shards, np.int64), int(left.sum()), n
        for s in range(shards):
            if not need:
                break
            good = int(left[s])
            rest -= good
            row[s] = rng.hypergeometric(good, rest, need) if good + rest < 10**9 else _large(rng, good, rest, need)
            need -= int(row[s])
        left -= row
        out.append(row.tolist())
    return out


def _large(rng, good: int, bad: int, need: int) -> int:
    """A hypergeometric draw of any size by ratio of uniforms (Stadlober 1990); numpy's ends at 1e9 rows."""
    total = good + bad
    low, high = max(0, need - bad), min(need, good)
    if low == high:
        return low
    mean = need * (good / total)
    spread = mean * (bad / total) * ((total - need) / max(1, total - 1))
    mode = min(high, max(low, (need + 1) * (good + 1) // (total + 2)))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high:
            gain = -sum(_log_factorials(x, y) for x, y in ((k, mode), (good - k, good - mode), (need - k, need - mode), (bad - need + k, bad - need + mode)))
            if 2 * math.log(u) <= gain:
                return k


def _log_factorials(x: int, y: int) -> float:
    """log(x! / y!), exact to about 1e-8 even where both are huge and close to each other."""
    if min(x, y) < 1000:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    # Stirling's series, with the difference taken before anything is rounded
    d = x - y
    return (y + 0.5) * math.log1p(d / y) + d * (math.log(x) - 1) + (1 / x - 1 / y) / 12 - (x**-3.0 - y**-3.0) / 360


def _range(key: str, ranges: int) -> Column:
    """The range of a 64-bit hash: its unsigned upper 31 bits, scaled."""
    return F.floor(F.shiftrightunsigned(F.col(key), 33) * F.lit(ranges) / F.lit(float(2**31))).cast("int")


def _ranked(rows: DataFrame, group: str, key: str, ranges: int, ties: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 in each group, by the hash ``key``; ranges are ranked apart."""
    rows = rows.withColumn("__range", _range(key, ranges))
    counts = rows.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(group, "__range", (F.sum("__n").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    # groups times ranges rows at most, both parameters
    rows = rows.join(F.broadcast(offsets), [group, "__range"])
    rank = F.row_number().over(W.partitionBy(group, "__range").orderBy(key, *ties)) - 1
    return rows.withColumn("rank", F.col("__before") + rank).drop("__range", "__before")


def assign_shards(docs: DataFrame, shards: int = 40, *, seed: int = 20, parts: int = 1024, ranges: int = 32, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the carried columns of every row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    kept = {f"__c{i}": c for i, c in enumerate(carry or [])}
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part"), *[F.col(f"`{c}`").alias(a) for a, c in kept.items()])
    # settled, so that partition numbers and counts stay true to each other
    slim = common.settle(slim, "shard-rows")
    counts = {r["part"]: r["n"] for r in slim.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # parts rows at most
    order = sorted(counts)
    matrix = draw_matrix([counts[p] for p in order], shards, seed)
    bounds = json.dumps([{"part": p, "bounds": np.cumsum(row).tolist()} for p, row in zip(order, matrix, strict=True)])
    matrix_rows = spark.range(1).select(F.inline(F.from_json(F.lit(bounds), "array<struct<part int, bounds array<long>>>")))
    ties = ["doc_id", "text_crc32", "size"]
    local = _ranked(slim.withColumn("__key", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed))), "part", "__key", ranges, ties)
    sent = local.join(F.broadcast(matrix_rows), "part")
    # the shard is the number of cumulative counts at or below the row's place in its partition
    sent = common.settle(sent.select("doc_id", "size", "text_crc32", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))).alias("shard"), *kept), "shard-sent")
    out = _ranked(sent.withColumn("__key", F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed + 1))), "shard", "__key", ranges, ties)
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"), *[F.col(a).alias(c) for a, c in kept.items()])


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes carried rows to a folder per shard, in slot order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    got = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
