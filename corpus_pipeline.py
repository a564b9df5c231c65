"""The corpus pipeline: five stages over documents, each one of the operators of ``waymark.llm``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. ``run`` writes each stage's result as Parquet to the shared folder
and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import common, op02_quality, op03_word_bpe, op05_decontamination, op08_pii, op09_neardup


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with an id of each row (the column's name is returned): doc_id, where that is the row's alone.

    Rows whose doc_id is null or stands in several rows get a negative hash of the whole row, so different
    rows are told apart, and only equal rows share an id. Such ids are settled and joined from a checked size.
    """
    uid, odd, n = ("_".join(["", name, *["x"] * len([c for c in docs.columns if c.startswith(f"_{name}")])]) for name in ("uid", "odd", "n"))
    repeated = docs.groupBy(F.col("doc_id").alias(odd)).agg(F.count(F.lit(1)).alias(n)).where((F.col(n) > 1) | F.col(odd).isNull())
    repeated = common.settle(repeated.select(odd), "repeated")
    if not repeated.limit(1).count():
        return docs.withColumn(uid, F.col("doc_id")), uid
    marked = repeated.select(odd, F.lit(True).alias(n))
    marked = F.broadcast(marked) if common.plan_bytes(repeated) <= 2 << 20 else marked
    own = -F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))), 2) - 1
    rows = docs.join(marked, F.col("doc_id").eqNullSafe(F.col(odd)), "left")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(n), own).otherwise(F.col("doc_id")).alias(uid)), uid


def _kept(rows: DataFrame, uid: str, verdicts: DataFrame) -> DataFrame:
    """The rows without those that the verdicts (doc_id, kept) by uid reject, which are settled and joined from a checked size."""
    gone = common.settle(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(uid)).distinct(), "rejected")
    return common.join_checked(rows, gone, [uid], "left_anti", most=4 << 20)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged on its own, whatever its id."""
    rows, uid = _identified(docs)
    return _kept(rows, uid, op02_quality.quality_rules(rows, doc_id=uid).select("doc_id", "kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8), that of the smallest id; rows with null or repeated ids count as smaller than others. Of equal rows one stays."""
    rows, uid = _identified(docs)
    kept = _kept(rows, uid, op09_neardup.near_duplicates(rows, shingle=5, percent=80, doc_id=uid).select("doc_id", "kept"))
    odd = kept.where(F.col(uid) < 0).dropDuplicates([uid])
    return kept.where(F.col(uid) >= 0).unionByName(odd).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op05_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    found = op08_pii.find(docs)
    return op08_pii.redact(docs, op08_pii.train(found))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return op03_word_bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: MCD estimates, edit search and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
