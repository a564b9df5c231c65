"""Queries of this subpackage and their SQL; the entry module adds them where the subpackage exists."""

from __future__ import annotations

import importlib
import importlib.util

from pyspark.sql import functions as F

_NAMES = {
    1: ("op01_warc", "op1_warc_salvage"),
    2: ("op02_quality", "op2_quality_rules"),
    3: ("op03_word_bpe", "op3_word_bpe"),
    4: ("op04_sharding", "op4_hypergeometric_shards"),
    5: ("op05_decontamination", "op5_cgk_decontamination"),
    6: ("op06_wavelet", "op6_wavelet_tokens"),
    7: ("op07_language", "op7_ppm_language"),
    8: ("op08_pii", "op8_pii_votes"),
    9: ("op09_neardup", "op9_circulant_minhash"),
    10: ("op10_cnn", "op10_byte_cnn"),
}

#: Columns of operators' results that SQL can express, so that whole tables can be held against it.
_COLUMNS = {
    "quality_base_columns": ("op2_quality_rules", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed"),
    "pii_base_spans": ("op8_pii_votes", "doc_id n_email n_ip n_card n_phone base_sha256"),
}


def _columns_of(query, names: str):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names.split())


def _shard_sizes(query):
    """How many shards have each number of rows, and whether their slots run from 0 without gaps."""

    def run(spark, sf_dir):
        shards = query(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("size_rows"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
        gapless = (F.col("low") == 0) & (F.col("high") == F.col("size_rows") - 1) & (F.col("slots") == F.col("size_rows"))
        return shards.groupBy("size_rows").agg(F.count(F.lit(1)).alias("n_shards"), F.min(gapless).alias("gapless"))

    return run


def queries() -> dict:
    found = {}
    for module, name in _NAMES.values():
        if importlib.util.find_spec(f"waymark.llm.{module}"):
            found[name] = getattr(importlib.import_module(f"waymark.llm.{module}"), name)
    for name, (query, columns) in _COLUMNS.items():
        if query in found:
            found[name] = _columns_of(found[query], columns)
    if "op4_hypergeometric_shards" in found:
        found["shard_sizes"] = _shard_sizes(found["op4_hypergeometric_shards"])
    return found


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLES
