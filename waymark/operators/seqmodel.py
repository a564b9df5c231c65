"""Sequence-model operators: tokenizers, CRF decoding and marginals, spans, country head, pooling.

A neural model is a plug: an emission provider maps (addr_id, text) to (addr_id, emissions, country_logits).
Only the CRF's recursions, WordPiece and the model itself run in Arrow batches; the rest are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# ---------------------------------------------------------------- tokens


def char_tokens(text: Column, vocabulary: list[str], size: int) -> tuple[Column, Column]:
    """Ids (unknown 0, pad 1, vocabulary from 2) and mask, both of a fixed size."""
    if any(len(c) != 1 for c in vocabulary):
        raise ValueError("vocabulary entries are single characters")
    known = F.create_map(*[x for i, c in enumerate(vocabulary) for x in (F.lit(c), F.lit(i + 2))])
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(text, ""), 1, size))
    ids = F.transform(chars, lambda c: F.coalesce(known[c], F.lit(0)))
    n = F.size(ids)
    return F.concat(ids, F.array_repeat(F.lit(1), size - n)), F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), size - n))


def char_decode(ids: Column, vocabulary: list[str]) -> Column:
    names = F.array(*[F.lit(c) for c in ["<UNKNOWN>", "<PAD>", *vocabulary]])
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(names, i), F.lit("<UNKNOWN>"))), "")


def read_vocabulary(lines: list[str]) -> dict[str, int]:
    """WordPiece vocabulary: ids in order of non-blank lines."""
    found = {t: i for i, t in enumerate(x.strip() for x in lines if x.strip())}
    missing = [t for t in ("[UNK]", "[CLS]", "[SEP]", "[PAD]") if t not in found]
    if missing:
        raise ValueError(f"vocabulary lacks {missing}")
    return found


def word_pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Greedy longest pieces; a word of more than 100 characters, or with no piece somewhere, is unknown."""
    if len(word) > 100:
        return [vocabulary["[UNK]"]]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(vocabulary[piece])
                at = end
                break
        else:
            return [vocabulary["[UNK]"]]
    return out


def encode_words(texts: DataFrame, vocabulary: dict[str, int], size: int) -> DataFrame:
    """Adds ``ids`` and ``mask``: [CLS], pieces, [SEP], padded or cut to size."""
    ready = texts.withColumn("__tokens", X.basic_tokens(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mask = [], []
            for words in b.column(b.num_columns - 1).to_pylist():
                row = [vocabulary["[CLS]"], *[i for w in words or [] for i in word_pieces(w, vocabulary)]][: size - 1] + [vocabulary["[SEP]"]]
                ids.append(row + [vocabulary["[PAD]"]] * (size - len(row)))
                mask.append([True] * len(row) + [False] * (size - len(row)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.bool_()))], names=[*b.schema.names[:-1], "ids", "mask"])

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

    return ready.mapInArrow(run, StructType(list(texts.schema.fields)).add("ids", ArrayType(IntegerType())).add("mask", ArrayType(BooleanType())))


def mean_pool(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the masked rows, scaled to length 1 unless it is zero."""
    kept = vectors[np.asarray(mask, bool)]
    mean = kept.mean(0) if len(kept) else np.zeros(vectors.shape[1])
    norm = np.linalg.norm(mean)
    return mean / norm if norm else mean


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


# ---------------------------------------------------------------- CRF


@dataclass
class Crf:
    """Start, end and transition scores; second-order transitions are added to the first-order ones where given."""

    start: list[float]
    end: list[float]
    transitions: list[list[float]]
    second: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        n = len(self.start)
        if not n or len(self.end) != n or len(self.transitions) != n or any(len(r) != n for r in self.transitions):
            raise ValueError("CRF parameters don't fit each other")
        self.step = np.array(self.transitions, float)
        for i, row in enumerate(self.second):
            for j, v in enumerate(row):
                self.step[i, j] += v

    def checked(self, emissions, mask) -> tuple[np.ndarray, np.ndarray]:
        if any(len(row) != len(self.start) for row in emissions):
            raise ValueError("emissions are ragged or don't have a score for each tag")
        if mask is not None and len(mask) != len(emissions):
            raise ValueError("mask and emissions differ in length")
        e = np.array(emissions, float).reshape(-1, len(self.start))
        valid = np.arange(len(e)) if mask is None else np.flatnonzero(np.asarray(mask, bool))
        return e[valid], valid

    def decode(self, emissions, mask=None) -> list[int]:
        """The best path over the valid positions; ties go to the smallest tag."""
        e, _ = self.checked(emissions, mask)
        if not len(e):
            return []
        score, back = np.array(self.start) + e[0], []
        for row in e[1:]:
            all_ = score[:, None] + self.step
            back.append(all_.argmax(0))
            score = all_.max(0) + row
        path = [int((score + np.array(self.end)).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def marginals(self, emissions, mask=None) -> np.ndarray:
        """P(tag) at each position by forward and backward sums; zeros at masked positions, and everywhere if no path is possible."""
        e, valid = self.checked(emissions, mask)
        out = np.zeros((len(emissions), len(self.start)))
        if not len(e):
            return out
        forward = [np.array(self.start) + e[0]]
        for row in e[1:]:
            forward.append(log_sum(forward[-1][:, None] + self.step, 0) + row)
        backward = [np.array(self.end, float)]
        for row in e[:0:-1]:
            backward.append(log_sum(self.step + (row + backward[-1])[None, :], 1))
        total = log_sum(forward[-1] + np.array(self.end), 0)
        if np.isneginf(total):
            return out
        out[valid] = np.exp(np.array(forward) + np.array(backward[::-1]) - total)
        return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isneginf(top), 0.0, top)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis))


def crf_apply(rows: DataFrame, crf: Crf) -> DataFrame:
    """Adds ``path`` and ``marginals`` to rows with ``emissions`` and, if present, ``mask``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(names.index("emissions")).to_pylist()
            m = b.column(names.index("mask")).to_pylist() if "mask" in names else [None] * len(e)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([crf.decode(x, y) for x, y in zip(e, m, strict=True)], pa.list_(pa.int32())), pa.array([crf.marginals(x, y).tolist() for x, y in zip(e, m, strict=True)], pa.list_(pa.list_(pa.float64())))], names=[*names, "path", "marginals"])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("path", ArrayType(IntegerType())).add("marginals", ArrayType(ArrayType(DoubleType()))))


def softmax(logits: Column) -> Column:
    grown = X.let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v.cast("double") - top)))
    return X.let(grown, lambda g: X.let(F.aggregate(g, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(g, lambda v: v / total)))


def country_head(logits: Column, names: list[str]) -> Column:
    """(country, confidence): the first of the greatest; ("", 0) without logits."""
    listed = F.array(*[F.lit(n) for n in names])
    none = F.struct(F.lit("").alias("country"), F.lit(0.0).alias("confidence"))
    found = X.let(softmax(logits), lambda p: F.struct(F.coalesce(F.get(listed, F.array_position(p, F.array_max(p)).cast("int") - 1), F.lit("")).alias("country"), F.array_max(p).alias("confidence")))
    return F.when(F.coalesce(F.size(logits), F.lit(0)) < 1, none).otherwise(found)


# ---------------------------------------------------------------- spans


def bio_spans(tokens: DataFrame, keys: list[str], order: list[str], strict: bool = True) -> DataFrame:
    """(keys, start, stop, tag) islands of rows (keys, order, bio, tag) by lag and running sum.

    Not strict: maximal runs of a tag. Strict: a span begins with B; runs of I that continue none become OTHER.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    rows = tokens.withColumn("at", F.row_number().over(w) - 1).withColumn("tag", F.when(F.col("bio") == "OTHER", "OTHER").otherwise(F.col("tag")))
    if strict:
        # an inside token belongs to the span that the latest B or OTHER or change of tag before it began
        prior = F.lag("tag").over(w)
        edge = (F.col("bio") == "B") | (F.col("bio") == "OTHER") | prior.isNull() | (prior != F.col("tag"))
        rows = rows.withColumn("run", F.sum(F.when(edge, 1).otherwise(0)).over(w))
        first = F.first("bio").over(W.partitionBy(*keys, "run").orderBy("at"))
        rows = rows.withColumn("tag", F.when(first == "B", F.col("tag")).otherwise("OTHER")).withColumn("lone", F.col("tag") == "OTHER")
        fresh = (F.col("bio") == "B") | (F.lag("tag").over(w) != F.col("tag")) | F.lag("tag").over(w).isNull()
    else:
        fresh = (F.lag("tag").over(w) != F.col("tag")) | F.lag("tag").over(w).isNull()
    rows = rows.withColumn("island", F.sum(F.when(fresh, 1).otherwise(0)).over(w))
    return rows.groupBy(*keys, "island").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"), F.min("tag").alias("tag")).drop("island")


def span_mean(series: Column, start: Column, stop: Column) -> Column:
    """Mean of a series over a clamped span; 0 if that is empty."""
    a, b = F.greatest(start, F.lit(0)), F.least(stop, F.size(series))
    part = F.slice(series, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.when(b > a, F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")) / (b - a)).otherwise(0.0)


def tag_series(marginals: Column, columns: list[int]) -> Column:
    """Per position the sum of a tag's columns."""
    return F.transform(marginals, lambda row: sum((F.coalesce(F.get(row, c), F.lit(0.0)) for c in columns), F.lit(0.0)))


def tag_probabilities(series: Column, tag: str, span_tags: Column) -> Column:
    """The series, or zeros for a tag that no decoded span has."""
    return F.when(F.array_contains(span_tags, tag), series).otherwise(F.transform(series, lambda v: F.lit(0.0)))


@dataclass
class EmissionProvider:
    """Where emissions come from: a table, or a function of Arrow batches such as an ONNX session."""

    table: DataFrame | None = None
    run: Callable | None = None
    schema: str = "addr_id long, emissions array<array<double>>, country_logits array<double>"

    def emissions(self, texts: DataFrame) -> DataFrame:
        if (self.table is None) == (self.run is None):
            raise ValueError("give a table or a function")
        if self.table is not None:
            return texts.select("addr_id").join(self.table, "addr_id", "left")
        return texts.select("addr_id", "text").mapInArrow(self.run, self.schema)


def onnx_provider(path: str, vocabulary: list[str], size: int) -> EmissionProvider:
    """Runs an exported model, one session a worker, over fixed-size character ids; needs onnxruntime where it runs."""

    def run(batches):
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        ids_of, (first, second) = {c: i + 2 for i, c in enumerate(vocabulary)}, [i.name for i in session.get_inputs()]
        for b in batches:
            rows = [[ids_of.get(c, 0) for c in t[:size]] for t in b.column(1).to_pylist()]
            ids = np.array([r + [1] * (size - len(r)) for r in rows], np.int64).reshape(-1, size)
            mask = np.array([[True] * len(r) + [False] * (size - len(r)) for r in rows]).reshape(-1, size)
            got = session.run(None, {first: ids, second: mask})
            if got[0].shape[:2] != ids.shape:
                raise ValueError(f"the model gave {got[0].shape} for {ids.shape}")
            logits = got[1].tolist() if len(got) > 1 else [[] for _ in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[0].astype(float).tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(logits, pa.list_(pa.float64()))], names=["addr_id", "emissions", "country_logits"])

    return EmissionProvider(run=run)


