"""Quality classifier: a byte-level convolutional network in numpy.

Input are a text's UTF-8 bytes at positions four bytes apart, embedded; a filter sees eight bytes (so
neighbours overlap) and whether the four bytes at each of its two positions also stand a few bytes before
(``LAGS``), which shows repetition. Filters are max-pooled over chunks of 128 positions that overlap by
half and cover the whole text; the chunks' vectors are combined by their mean and maximum, a hidden layer
and a logistic unit into one probability.

Training: on the driver, from a bounded, balanced sample of labelled rows (``per_class`` each at most,
by hash) whose fold isn't held out, whole texts, Adam with fixed seeds. With labels of one class or none,
the score is that class's share, or 0.5.

Edge cases: null and empty texts are scored as an empty input; rows repeat with equal scores; null ids and
extra columns are ignored; null labels and repeated labels of an id (the larger counts) are handled; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, HALF, EMBED, FILTERS, HIDDEN = 4, 64, 8, 24, 16
#: Distances in bytes at which repetition is looked for.
LAGS = tuple(range(2, 17))
NEVER = np.float32(-1e9)
#: Bytes that are laid out at once, a multiple of a half's.
SLICE = 1 << 20


class Layout:
    """Rows of bytes laid out in halves of HALF positions: ``cells`` [position, 4], ``real`` positions, ``first`` half of each row (n + 1), ``last`` position of each row, ``repeat`` flags."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        halves = np.maximum(1, -(-size // (WIDTH * HALF)))
        self.first = np.concatenate([[0], np.cumsum(halves)])
        total = int(self.first[-1]) * HALF
        flat = np.zeros(total * WIDTH + 32, np.uint8)
        at = np.repeat(self.first[:-1] * HALF * WIDTH - offsets[:-1], size) + np.arange(len(data)) + 16
        flat[at] = data
        self.cells = flat[16 : 16 + total * WIDTH].reshape(total, WIDTH)
        positions = np.maximum(1, -(-size // WIDTH))
        self.last = self.first[:-1] * HALF + positions - 1
        place = np.arange(total)
        row = np.repeat(np.arange(len(size)), halves * HALF)
        self.real = place <= self.last[row]
        now = flat[16 : 16 + total * WIDTH].view("<u4")
        hit = np.zeros(total, bool)
        for d in LAGS:
            hit |= np.ndarray((total,), "<u4", flat, 16 - d, (4,)) == now
        inner = place * WIDTH - self.first[row] * HALF * WIDTH >= max(LAGS)
        self.repeat = (hit & inner & (now != 0)).astype(np.float32)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two halves of each chunk, and the first chunk of each row."""
        halves = np.diff(self.first)
        n = np.maximum(1, halves - 1)
        begin = np.concatenate([[0], np.cumsum(n)])
        left = np.repeat(self.first[:-1] - begin[:-1], n) + np.arange(begin[-1])
        right = np.where(np.repeat(halves, n) > 1, left + 1, left)
        return left, right, begin


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        k = WIDTH * EMBED
        self.p = {"E": draw(256, EMBED, scale=0.5), "A": draw(k, FILTERS, scale=0.12), "B": draw(k, FILTERS, scale=0.12), "R": draw(2, FILTERS, scale=0.5), "c": np.zeros(FILTERS, np.float32), "H": draw(2 * FILTERS, HIDDEN, scale=0.2), "h": np.zeros(HIDDEN, np.float32), "o": draw(HIDDEN, scale=0.3), "z": np.zeros(1, np.float32)}

    def conv(self, x: Layout) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        e = p["E"][x.cells].reshape(len(x.cells), WIDTH * EMBED)
        out = e @ p["A"]
        after = e @ p["B"]
        out[:-1] += after[1:]
        out[x.last] += np.tile(p["E"][0], WIDTH) @ p["B"] - (np.vstack([after[1:], np.zeros((1, FILTERS), np.float32)])[x.last])
        hit = np.flatnonzero(x.repeat)
        out[hit] += p["R"][0]
        before = hit[hit > 0] - 1
        before = before[~np.isin(before, x.last)]
        out[before] += p["R"][1]
        out += p["c"]
        out[~x.real] = NEVER
        return out, e

    def halves(self, data: np.ndarray) -> np.ndarray:
        """The maxima of each half of one text, slice by slice: neighbours lend a half to each side of a slice."""
        step, parts = HALF * WIDTH, []
        for a in range(0, len(data), SLICE):
            begin, end = max(0, a - step), min(len(data), a + SLICE + step)
            out, _ = self.conv(Layout(data[begin:end], np.array([0, end - begin])))
            got = out.reshape(-1, HALF, FILTERS).max(1)[(a - begin) // step :]
            parts.append(got[: SLICE // step])
        return np.concatenate(parts)

    def score_long(self, data: np.ndarray) -> np.ndarray:
        """The score of one text of more than a slice."""
        half = self.halves(data)
        return self._scored(np.maximum(np.maximum(half[:-1], half[1:]), 0), np.array([0, len(half) - 1]))

    def score(self, x: Layout) -> np.ndarray:
        out, _ = self.conv(x)
        half = out.reshape(-1, HALF, FILTERS).max(1)
        left, right, begin = x.chunks()
        return self._scored(np.maximum(np.maximum(half[left], half[right]), 0), begin)

    def _scored(self, chunk: np.ndarray, begin: np.ndarray) -> np.ndarray:
        doc = np.concatenate([np.add.reduceat(chunk, begin[:-1], axis=0) / np.diff(begin)[:, None], np.maximum.reduceat(chunk, begin[:-1], axis=0)], 1)
        hidden = np.tanh(doc @ self.p["H"] + self.p["h"])
        return 1 / (1 + np.exp(-np.clip(hidden @ self.p["o"] + self.p["z"], -40, 40)))

    def gradients(self, x: Layout, y: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        out, e = self.conv(x)
        cube = out.reshape(-1, HALF, FILTERS)
        arg = cube.argmax(1)
        half = np.take_along_axis(cube, arg[:, None, :], 1)[:, 0]
        left, right, begin = x.chunks()
        pick = np.where(half[left] >= half[right], left[:, None], right[:, None])
        chunk = np.maximum(np.take_along_axis(half, pick, 0), 0)
        n = np.diff(begin)
        mean, top = np.add.reduceat(chunk, begin[:-1], axis=0) / n[:, None], np.maximum.reduceat(chunk, begin[:-1], axis=0)
        doc = np.concatenate([mean, top], 1)
        hidden = np.tanh(doc @ p["H"] + p["h"])
        score = 1 / (1 + np.exp(-np.clip(hidden @ p["o"] + p["z"], -40, 40)))
        d = ((score - y) / len(y)).astype(np.float32)
        g["z"], g["o"] = d.sum(keepdims=True), hidden.T @ d
        dh = d[:, None] * p["o"] * (1 - hidden**2)
        g["h"], g["H"] = dh.sum(0), doc.T @ dh
        dd = dh @ p["H"].T
        row = np.repeat(np.arange(len(n)), n)
        dc = (dd[:, :FILTERS] / n[:, None])[row]
        best = chunk == top[row]
        ties = np.add.reduceat(best.astype(np.float32), begin[:-1], axis=0)
        dc = dc + np.where(best, dd[row, FILTERS:] / ties[row], 0)
        dc = np.where(chunk > 0, dc, 0)
        # only the positions that won a maximum pass a gradient on
        flat_f = np.broadcast_to(np.arange(FILTERS), pick.shape)
        where = pick * HALF + np.take_along_axis(arg, pick, 0)
        live = dc != 0
        pos, fil, val = where[live], flat_f[live], dc[live]
        used, at = np.unique(pos, return_inverse=True)
        dense = np.zeros((len(used), FILTERS), np.float32)
        np.add.at(dense, (at, fil), val)
        ends = np.isin(used, x.last)
        nxt = np.minimum(used + 1, len(e) - 1)
        pad = np.tile(p["E"][0], WIDTH)
        e_next = np.where(ends[:, None], pad, e[nxt])
        g["A"], g["B"], g["c"] = e[used].T @ dense, e_next.T @ dense, dense.sum(0)
        g["R"] = np.stack([x.repeat[used] @ dense, np.where(ends, 0, x.repeat[nxt]) @ dense])
        de = np.zeros((256, EMBED), np.float32)
        np.add.at(de, x.cells[used].ravel(), (dense @ p["A"].T).reshape(-1, EMBED))
        cells_next = np.where(ends[:, None], 0, x.cells[nxt])
        np.add.at(de, cells_next.ravel(), (dense @ p["B"].T).reshape(-1, EMBED))
        g["E"] = de
        return g

    def fit(self, texts: pa.Array, labels: np.ndarray, *, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 6) -> Net:
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                g = self.gradients(Layout(*common.flat_text(texts.take(pa.array(some)))), labels[some].astype(np.float32))
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 1000) -> dict | float:
    """The network's parameters, or the share of ones where only one class is known."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (common.doc_fold() != 2)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    if len(sizes) < 2:
        return float(next(iter(sizes))) if sizes else 0.5
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 33) / F.lit(float(2**31))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))])
    chosen = common.settle(known.where(drawn < share[F.col("label")]), "labelled")
    # about 2 * per_class rows: a broadcast of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toArrow().combine_chunks()
    if not rows.num_rows:
        return 0.5
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    y = rows.column("label").to_numpy().astype(np.float32)[order]
    return Net().fit(common.one(rows, "text").take(pa.array(order)), y).p


def predict(docs: DataFrame, learned: dict | float) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    sent, name = spark.sparkContext.broadcast(learned), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        if not isinstance(net, float):

            def make():
                made = Net()
                made.p = sent.value
                return made

            net = common.latest("cnn", name, make)
        for table in common.gathered(batches, most=1 << 20):
            data, offsets = common.flat_text(common.one(table, "text"))
            if isinstance(net, float):
                score = np.full(table.num_rows, net)
            else:  # a text of more than a slice comes alone
                score = net.score_long(data) if table.num_rows == 1 and len(data) > SLICE else net.score(Layout(data, offsets))
            yield pa.RecordBatch.from_arrays([common.one(table, "doc_id"), pa.array(np.round(score.astype(np.float64), 6), pa.float64())], names=["doc_id", "score"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(common.tidy(run), source.drop("text").schema.add("score", "double"))


def op10_byte_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select("doc_id", (F.coalesce(common.doc_fold(), F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
