"""Whole jobs and their plugs: filling the cache, evaluating a resolver, embedders and judges.

Embedders map (item, key) to (item, embedding) and judges (addr_id, text, countries, towns) to decisions; both are
DataFrame functions, so a recorded table, an ONNX session or an HTTP service can stand behind them.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from . import cache as C
from . import evaluate as V
from . import fill as L
from .resolve import combinations, structured
from .seqmodel import encode_words, mean_pool

Embedder = Callable[[DataFrame], DataFrame]
Judge = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- embedders


def table_embedder(vectors: DataFrame) -> Embedder:
    """Recorded embeddings (key, embedding); keys without one stay without."""
    return lambda rows: rows.join(vectors.select("key", "embedding"), "key", "left").select("item", "embedding")


def hashed_embedder(width: int = 64) -> Embedder:
    """A stand-in without a model: signed hashes of character trigrams, scaled to length 1. Near texts get near vectors."""

    def embed(rows: DataFrame) -> DataFrame:
        grams = X.trigrams(F.col("key"))
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.when(F.pmod(F.xxhash64(g), F.lit(width)) == k, F.when(F.pmod(F.xxhash64(g, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return rows.select("item", X.let(sums, lambda v: X.let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))).alias("embedding"))

    return embed


def onnx_embedder(path: str, vocabulary: dict[str, int], size: int = 256) -> Embedder:
    """A local sentence model: WordPiece ids, one session a worker, masked mean, length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        names = [i.name for i in session.get_inputs()]
        if len(names) not in (2, 3) or len(session.get_outputs()) != 1:
            raise ValueError(f"{path}: a sentence model has two or three inputs and one output")
        for b in batches:
            ids = np.array(b.column("ids").to_pylist(), np.int64).reshape(-1, size)
            mask = np.array(b.column("mask").to_pylist(), np.int64).reshape(-1, size)
            (got,) = session.run(None, dict(zip(names, [ids, mask, np.zeros_like(ids)], strict=False)))
            if got.shape[:2] != ids.shape:
                raise ValueError(f"the model gave {got.shape} for {ids.shape}")
            rows = [mean_pool(v.astype(float), m).tolist() for v, m in zip(got, mask, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(rows, pa.list_(pa.float64()))], names=["item", "embedding"])

    return lambda rows: encode_words(rows.select("item", F.col("key").alias("text")), vocabulary, size).select("item", "ids", "mask").mapInArrow(run, "item long, embedding array<double>")


def service_url(base: str, path: str) -> str:
    """A service's address; a base that ends in /v1 isn't given another."""
    base = base.rstrip("/")
    return base + (path.removeprefix("/v1") if base.endswith("/v1") else path)


def http_post(url: str, body: dict, key: str = "", timeout: float = 30.0) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
        return json.load(answer)


def http_embedder(base: str, model: str, key: str = "", post: Callable = http_post) -> Embedder:
    """An embedding service; a batch of keys a call. ``post`` can be replaced by a fake. A failed call gives null embeddings."""
    url = service_url(base, "/v1/embeddings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).to_pylist()
            try:
                data = sorted(post(url, {"model": model, "input": keys}, key)["data"], key=lambda x: x.get("index", 0))
                rows = [x["embedding"] for x in data]
            except (OSError, KeyError, ValueError):
                rows = [None] * len(keys)
            if len(rows) != len(keys):
                rows = [None] * len(keys)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["item", "embedding"])

    return lambda rows: rows.select("item", "key").mapInArrow(run, "item long, embedding array<double>")


def embedder(backend: str, **options) -> Embedder:
    """By the backend's name: openai or http, onnx or local, hashed."""
    known = {"openai": http_embedder, "http": http_embedder, "onnx": onnx_embedder, "local": onnx_embedder, "hashed": hashed_embedder}
    name = backend.strip().lower()
    if name not in known:
        raise ValueError(f"unknown embedding backend {backend!r}")
    return known[name](**options)


# ---------------------------------------------------------------- judges


def recorded_judge(decisions: DataFrame) -> Judge:
    """Decisions (addr_id, resolved, judge_country, judge_town) from a table."""
    return lambda requests: requests.join(decisions, "addr_id", "left").select("addr_id", "resolved", "judge_country", "judge_town", "countries", "towns")


def http_judge(base: str, model: str, key: str = "", post: Callable = http_post) -> Judge:
    """A chat service that chooses among an address's candidates, at temperature 0 and as JSON."""
    url = service_url(base, "/v1/chat/completions")
    rule = "Choose country and town of the address among the candidates. Answer with JSON: resolved, country, town, reason."

    def one(text: str, countries, towns) -> tuple:
        body = {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": rule}, {"role": "user", "content": json.dumps({"address": text, "countries": countries, "towns": towns})}]}
        said = json.loads(post(url, body, key, 60.0)["choices"][0]["message"]["content"])
        return bool(said.get("resolved")), str(said.get("country") or ""), str(said.get("town") or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*row) for row in zip(*[b.column(c).to_pylist() for c in ("text", "countries", "towns")], strict=True)]
            r, c, t = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r, pa.bool_()), pa.array(c, pa.string()), pa.array(t, pa.string())], names=["addr_id", "resolved", "judge_country", "judge_town"])

    def judge(requests: DataFrame) -> DataFrame:
        said = requests.select("addr_id", "text", "countries", "towns").mapInArrow(run, "addr_id long, resolved boolean, judge_country string, judge_town string")
        return said.join(requests.select("addr_id", "countries", "towns"), "addr_id")

    return judge


def judge_requests(combos: DataFrame, addresses: DataFrame) -> DataFrame:
    return addresses.select("addr_id", "text").join(L.candidates(combos), "addr_id")


# ---------------------------------------------------------------- filling the cache


def fill(resolved: DataFrame, cache: DataFrame | None, *, embed: Embedder | None = None, judge: Judge | None = None, requests: DataFrame | None = None, least: float = 0.0, dry_run: bool = False) -> dict[str, DataFrame | None]:
    """Decides every resolved row: ``cache`` (the snapshot after the upsert), ``review`` and ``summary``.

    A judge sees the candidates of ``requests`` for rows below the high band. A dry run writes nothing to the cache.
    """
    if not dry_run and (cache is None or embed is None):
        raise ValueError("filling needs a cache and an embedder, or a dry run")
    if judge is not None and requests is None:
        raise ValueError("a judge needs the requests")
    decisions = judge(requests.join(resolved.where("band <> 'high'").select("addr_id"), "addr_id", "left_semi")) if judge is not None else None
    decided = L.decide(resolved, decisions)
    summary = L.summary(decided, least)
    if dry_run:
        return {"cache": cache, "review": L.review_rows(decided), "summary": summary.withColumn("cached", F.lit(0).cast("long"))}
    rows = L.cache_rows(decided, least).withColumn("item", F.monotonically_increasing_id())
    made = rows.join(embed(rows.select("item", F.col("normalized_address").alias("key"))), "item").withColumnRenamed("item", "ord")
    return {"cache": C.upsert(cache, made), "review": L.review_rows(decided), "summary": summary}


def count_by_source(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- evaluation


def evaluate(labelled: DataFrame, resolver: Callable[[DataFrame], DataFrame], *, limit: int = 1000, seed: int = 42, mode: str = "address-town", country: str = "") -> dict[str, DataFrame]:
    """Draws a stratified sample of labelled rows (id, address, town, country), resolves it: ``accuracy`` by stratum and in all, ``mismatches``."""
    rows = labelled.where(X.country_code(F.col("country")) == country.strip().upper()) if country else labelled
    sample = V.fetch(V.plan(V.groups(rows), limit, seed), rows)
    got = resolver(sample.select(F.col("id").alias("addr_id"), V.input_text(mode).alias("text")))
    both = sample.join(got.select(F.col("addr_id").alias("id"), F.col("country").alias("actual_country"), F.col("town").alias("actual_town")), "id")
    zipped = both.select("id", "stratum", F.col("country").alias("expected_country"), F.col("town").alias("expected_town"), "actual_country", "actual_town")
    return {"accuracy": V.accuracy(zipped), "mismatches": V.mismatches(zipped)}


def report(accuracy: DataFrame, **run) -> dict:
    """The run's parameters and its rates, for a JSON report; a row a stratum."""
    rows = [r.asDict() for r in accuracy.orderBy("stratum").collect()]
    return {"run": run, "overall": next((r for r in rows if r["stratum"] is None), {}), "strata": [r for r in rows if r["stratum"] is not None]}


def resolver_of(matched: Callable[[DataFrame], tuple[DataFrame, DataFrame]], limits: S.Limits = S.LIMITS) -> Callable[[DataFrame], DataFrame]:
    """A resolver from a function that gives scored countries and towns of addresses: other matchers can stand in."""

    def run(addresses: DataFrame) -> DataFrame:
        countries, towns = matched(addresses)
        return structured(combinations(countries, towns, addresses), addresses)

    return run
