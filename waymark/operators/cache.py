"""The result cache: exact and nearest-neighbour lookups, trust and gates, upserts, the two-stage cascade."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import score as K
from ..functions import text as X
from ..settle import settle


def trusted(source: Column, limits: S.Limits = S.LIMITS) -> Column:
    listed = ["human_verified", "crf_pipeline"] + ["sonnet_seed"] * limits.trust_seed + ["llm_assisted"] * limits.trust_assisted
    return F.coalesce(source.isin(*listed), F.lit(False))


def exact_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (…, key) with the cache entry of an equal key, if any, as the struct ``hit``."""
    return requests.join(cache.select(F.col("normalized_address").alias("key"), F.struct(*cache.columns).alias("hit")), "key", "left")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = S.LIMITS.neighbours, *, block: int = 2048) -> DataFrame:
    """(query_id, entry_id, similarity, rank): exact cosine neighbours, ties by entry_id; k <= 0 means the default.

    The vector search is exact, as the data model's is. Queries are a stated set or a request's misses; they are
    dealt into blocks of at most ``block`` rows, each a row of its own that meets every partition of entries, where
    a matrix product and a partial choice leave k rows a query and batch. So neither side is sent out whole.
    """
    k = k if k > 0 else S.LIMITS.neighbours
    n = max(1, -(-queries.count() // block))
    ids = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["entry_id"]
    numbered = queries.where("embedding is not null").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    found = None
    for part in range(n):
        rows = numbered.where(F.col("part") == part).select("query_id", "embedding").toArrow()  # a block, bounded
        if not rows.num_rows:
            continue
        got = vectors.where("embedding is not null").select("entry_id", "embedding").mapInArrow(_neighbours(rows, k), f"query_id {ids[0]}, entry_id {ids[1]}, similarity double")
        found = got if found is None else found.union(got)
    if found is None:
        found = queries.select("query_id").join(vectors.select("entry_id"), F.lit(False)).withColumn("similarity", F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _neighbours(queries: pa.Table, k: int):
    def matrix(column) -> np.ndarray:
        flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = queries.column("query_id").combine_chunks()
        q = matrix(queries.column("embedding"))
        length = np.sqrt((q * q).sum(1))
        for b in batches:
            if not b.num_rows:
                continue
            e = matrix(b.column(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                near = (q @ e.T) / np.sqrt(np.outer(length * length, (e * e).sum(1)))
            order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")), near.shape), -near), axis=1)[:, :k]
            take = pa.array(order.ravel())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(q)), order.shape[1]))), b.column(0).take(take), pa.array(np.take_along_axis(near, order, 1).ravel())], names=["query_id", "entry_id", "similarity"])

    return run


def gate(candidates: DataFrame, limits: S.Limits = S.LIMITS) -> DataFrame:
    """Of candidates (item, rank, semantic, lexical, source): the first that passes all gates, or the last one's scores and reason."""
    reason = F.when(F.col("semantic") < limits.semantic, "semantic_gate_failed").when(F.col("lexical") < limits.lexical, "lexical_gate_failed").when(~trusted(F.col("source"), limits), "untrusted_cache_source")
    rows = candidates.withColumn("reason", reason)
    passing = F.when(F.col("reason").isNull(), F.col("rank"))
    state = F.struct("semantic", "lexical", "source", "reason", "rank")
    return rows.groupBy("item").agg(F.coalesce(F.min_by(state, passing), F.max_by(state, "rank")).alias("s")).select("item", "s.*").withColumn("served", F.col("reason").isNull())


def upsert(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """The cache after an upsert by normalized_address.

    A human-verified entry keeps its source and content unless the incoming one is human-verified too; the
    raw address, embedding and updated_at are always the incoming ones. Of several incoming rows of a key
    the last (greatest ``ord``) wins. The result is a new snapshot, never written over what it reads.
    """
    if "ord" in incoming.columns:
        incoming = incoming.groupBy("normalized_address").agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in ("ord", "normalized_address")]), "ord").alias("s")).select("normalized_address", "s.*")
    o, n = cache.alias("o"), incoming.alias("n")
    both = o.join(n, F.col("o.normalized_address") == F.col("n.normalized_address"), "full")
    no_new, no_old = F.col("n.normalized_address").isNull(), F.col("o.normalized_address").isNull()
    keep = no_new | (~no_old & (F.col("o.source") == "human_verified") & (F.col("n.source") != "human_verified"))
    always = ("raw_address", "embedding", "updated_at")
    out = []
    for c in cache.columns:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        if c == "normalized_address":
            out.append(F.coalesce(new, old).alias(c))
        elif c in always:
            out.append(F.when(no_new, old).otherwise(new).alias(c))
        elif c not in incoming.columns:
            out.append(old.alias(c))
        elif c in ("id", "created_at"):
            out.append(F.coalesce(old, new).alias(c))
        else:
            out.append(F.when(keep, old).otherwise(new).alias(c))
    return both.select(*out)


STAGE1 = ("item", "text", "key", "served", "structured", "cache_source", "semantic", "lexical", "reason", "embedding")


def stage1(requests: DataFrame, cache: DataFrame | None, embed: Callable[[DataFrame], DataFrame] | None, limits: S.Limits = S.LIMITS, held: list[str] | None = None) -> DataFrame:
    """item, text, key, served, structured, cache_source, semantic, lexical, reason and embedding of requests (item, text).

    A blank address fails the request. Without a cache all miss as stage1_unconfigured. Exact trusted hits are
    served without an embedding; the others go on to neighbours if there is an embedder ((item, key) to
    (item, embedding)): without an embedding they miss as embedding_error, without neighbours as cache_miss. A
    cache whose rows can't be read fails the lookups as cache_error: ``cache`` may have a column ``failed``.
    """
    key = X.normalize_address(F.col("text"))
    rows = requests.select("item", "text", F.when(key != "", key).otherwise(F.raise_error(F.concat(F.lit("text is required: item "), F.col("item").cast("string"))).cast("string")).alias("key"))
    none, text = F.lit(None), F.lit(None).cast("string")
    structure = cache.schema["structured"].dataType if cache is not None else "string"
    number, vector = none.cast("double"), none.cast("array<double>")

    def state(df: DataFrame, served: bool, structured: Column, source: Column, semantic: Column, lexical: Column, reason: Column, embedding: Column) -> DataFrame:
        return df.select("item", "text", "key", F.lit(served).alias("served"), structured.alias("structured"), source.alias("cache_source"), semantic.alias("semantic"), lexical.alias("lexical"), reason.alias("reason"), embedding.alias("embedding"))

    def missed(df: DataFrame, reason: Column, lexical: Column = number, embedding: Column = vector) -> DataFrame:
        return state(df, False, none.cast(structure), text, number, lexical, reason, embedding)

    if cache is None:
        return missed(rows, F.lit("stage1_unconfigured"))
    looked = exact_lookup(rows, cache)
    failed = F.coalesce(F.col("hit.failed"), F.lit(False)) if "failed" in cache.columns else F.lit(False)
    hit = trusted(F.col("hit.source"), limits) & ~failed
    done = state(looked.where(hit), True, F.col("hit.structured"), F.col("hit.source"), number, F.lit(1.0), text, vector)
    broken = missed(looked.where(failed), F.lit("cache_error"))
    exact = F.col("hit").isNotNull()
    rest = looked.where(~hit & ~failed).select("item", "text", "key", F.when(exact, "untrusted_cache_source").otherwise("cache_miss").alias("reason"), F.when(exact, 1.0).alias("lexical"))
    done = done.unionByName(broken)
    if embed is None:
        return done.unionByName(missed(rest, F.col("reason"), F.col("lexical")))
    # the embedding is made once; later steps and the write-back read it
    rest = settle(rest.join(embed(rest.select("item", "key")).select("item", F.col("embedding").cast("array<double>").alias("embedding")), "item", "left"), "embedded", held)
    unknown = missed(rest.where("embedding is null"), F.lit("embedding_error"))
    known = rest.where("embedding is not null")
    found = nearest(known.select(F.col("item").alias("query_id"), "embedding"), cache.select(F.col("normalized_address").alias("entry_id"), "embedding"), limits.neighbours)
    entries = cache.select(F.col("normalized_address").alias("entry_id"), "source", "structured")
    full = found.withColumnRenamed("query_id", "item").join(entries, "entry_id").join(known.select("item", "key"), "item")
    judged = full.select("item", "rank", F.col("similarity").alias("semantic"), X.lexical_identity(F.col("key"), F.col("entry_id")).alias("lexical"), "source", "structured")
    served = gate(judged, limits).join(judged.select("item", "rank", "structured"), ["item", "rank"])
    out = known.join(served.withColumnsRenamed({"reason": "why", "lexical": "near"}), "item", "left")
    ok = F.coalesce(F.col("served"), F.lit(False))
    seen = F.col("served").isNotNull()
    more = out.select("item", "text", "key", ok.alias("served"), F.when(ok, F.col("structured")).alias("structured"), F.when(ok, F.col("source")).alias("cache_source"), "semantic", F.when(seen, F.col("near")).alias("lexical"), F.when(~ok, F.when(seen, F.col("why")).otherwise("cache_miss")).alias("reason"), "embedding")
    return done.unionByName(unknown).unionByName(more)


def convert(requests: DataFrame, cache: DataFrame | None, resolver: Callable[[DataFrame], DataFrame], embed=None, limits: S.Limits = S.LIMITS) -> tuple[DataFrame, DataFrame]:
    """(items, upserts): stage 1, then the resolver on the misses alone, both with quality; misses with an embedding are written back as crf_pipeline.

    resolver: (addr_id, text) to rows with addr_id, country, town, postal_code, street and confidences. Stage 1 and
    the resolver run once: their rows are settled, ``settle.release(items)`` removes them.
    """
    parts = ("address_line", "country", "town", "postal_code", "street", "country_confidence", "town_confidence")
    held: list[str] = []
    first = settle(stage1(requests, cache, embed, limits, held), "stage1", held)
    misses = first.where(~F.col("served"))
    made = resolver(misses.select(F.col("item").alias("addr_id"), "text"))
    held += getattr(made, "held", [])
    second = settle(misses.drop("structured", "cache_source").join(made.select(F.col("addr_id").alias("item"), F.struct(*parts).alias("structured")), "item"), "stage2", held)
    second = second.withColumn("cache_source", F.lit("crf_pipeline"))

    def named(df: DataFrame, by: str) -> DataFrame:
        return df.select("item", F.col("text").alias("input"), "structured", F.lit(by).alias("served_by"), "cache_source", F.col("semantic").alias("semantic_score"), F.col("lexical").alias("lexical_score"), F.col("reason").alias("fallback_reason"))

    items = named(second, "stage2_pipeline")
    if cache is not None:
        items = items.unionByName(named(first.where("served"), "stage1_cache"))
    q = K.quality(F.col("structured.country"), F.col("structured.town"), F.col("structured.country_confidence"), F.col("structured.town_confidence"))
    items = items.withColumn("q", q).withColumns({"resolution_status": F.col("q.status"), "confidence_band": F.col("q.band")}).drop("q")
    kept = second.where("embedding is not null") if cache is not None else second.where("false")
    upserts = kept.select(F.col("item").alias("ord"), F.col("text").alias("raw_address"), F.col("key").alias("normalized_address"), F.col("cache_source").alias("source"), "structured", F.col("structured.country").alias("country_code"), "structured.town", "structured.postal_code", "structured.street", "embedding")
    items.held = held
    return items, upserts
