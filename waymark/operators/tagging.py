"""The model path: emissions to CRF, spans, predictions, per-tag series and the country head.

A ``ModelRunner`` takes emissions from its provider (a table or a function of Arrow batches), decodes them and gives
what the resolver reads: address columns ``spans``, ``predictions`` and ``head``, and a long table of per-tag series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seqmodel import Crf, EmissionProvider, country_head

SPAN = "struct<start:int,stop:int,tag:string>"
PREDICTION = "struct<tag:string,start:int,stop:int,confidence:double,text:string>"
TAGGED = f"addr_id long, spans array<{SPAN}>, predictions array<{PREDICTION}>, series map<string,array<double>>, scores map<string,array<double>>"


def islands(tags: list[tuple[str, str]], strict: bool) -> list[tuple[int, int, str]]:
    """(start, stop, tag) of successive (bio, tag): runs of a tag; if strict, a run begins with B, and I behind none is OTHER."""
    out: list[tuple[int, int, str]] = []
    for at, (bio, tag) in enumerate(tags):
        tag = "OTHER" if bio == "OTHER" else tag
        last = out[-1] if out else None
        if strict and bio == "I" and not (last and last[2] == tag and last[2] != "OTHER"):
            tag = "OTHER"
        goes_on = last is not None and last[2] == tag and not (strict and bio == "B")
        if goes_on:
            out[-1] = (last[0], at + 1, tag)
        else:
            out.append((at, at + 1, tag))
    return out


@dataclass
class ModelRunner:
    """A tagger: provider, CRF, the (bio, tag) of each CRF state, names of the country head's outputs."""

    provider: EmissionProvider
    crf: Crf
    tags: list[tuple[str, str]]
    countries: list[str]
    max_length: int = 224
    strict: bool = True

    def __post_init__(self):
        if self.provider is None or self.crf is None:
            raise ValueError("a model runner needs a provider and a CRF")
        if self.max_length <= 0:
            raise ValueError("the longest sequence must be positive")
        if not self.tags or len(self.tags) != len(self.crf.start):
            raise ValueError("a tag is needed for each state of the CRF")

    def columns_of(self) -> dict[str, list[int]]:
        """States that make up a tag's series: all of its own, for OTHER the first alone."""
        out: dict[str, list[int]] = {}
        for k, (_, tag) in enumerate(self.tags):
            if tag != "OTHER" or tag not in out:
                out.setdefault(tag, []).append(k)
        return out

    def tag_one(self, text: str, emissions: list[list[float]]):
        """Spans, predictions, and by tag the sums of marginals and of emissions, zeros where no span has the tag."""
        n = min(len(text), self.max_length, len(emissions))
        mask = [k < n for k in range(len(emissions))]
        path, marginals = self.crf.decode(emissions, mask), self.crf.marginals(emissions, mask)
        spans = islands([self.tags[k] for k in path], self.strict)
        seen, columns = {s[2] for s in spans}, self.columns_of()
        raw = np.array(emissions, float).reshape(len(emissions), len(self.tags))
        pick = lambda m, t: (m[:, columns.get(t, [])].sum(1) if t in seen else np.zeros(len(m))).tolist()
        names = sorted(set(columns) | seen)
        series, scores = {t: pick(marginals, t) for t in names}, {t: pick(raw, t) for t in names}
        predictions = [{"tag": t, "start": a, "stop": b, "confidence": float(np.mean(series[t][a:b])) if b > a else 0.0, "text": text[a:b]} for a, b, t in spans]
        return [{"start": a, "stop": b, "tag": t} for a, b, t in spans], predictions, series, scores

    def tag(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(addresses, probabilities): texts (addr_id, text, ...) with ``spans``, ``predictions`` and ``head``; and (addr_id, tag, series, emissions)."""
        got = self.provider.emissions(texts)
        ready = texts.select("addr_id", "text").join(got, "addr_id")
        schema = ready.select("addr_id", "text", "emissions").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [self.tag_one(t or "", e or []) for t, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                doubles = pa.map_(pa.string(), pa.list_(pa.float64()))
                span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("tag", pa.string())]))
                prediction = pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("confidence", pa.float64()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], span), pa.array([r[1] for r in rows], prediction), pa.array([list(r[2].items()) for r in rows], doubles), pa.array([list(r[3].items()) for r in rows], doubles)], names=["addr_id", "spans", "predictions", "series", "scores"])

        provider, self.provider = self.provider, None  # a table can't go to the workers
        try:
            tagged = ready.select(*schema.names).mapInArrow(run, TAGGED)
        finally:
            self.provider = provider
        heads = ready.select("addr_id", country_head(F.col("country_logits"), self.countries).alias("head"))
        addresses = texts.join(tagged.select("addr_id", "spans", "predictions"), "addr_id", "left").join(heads, "addr_id", "left")
        long = tagged.select("addr_id", F.explode("series").alias("tag", "series"), "scores").select("addr_id", "tag", "series", F.col("scores")[F.col("tag")].alias("emissions"))
        return addresses, long
