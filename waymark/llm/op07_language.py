"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order ``order``; a byte costs -log2 of its probability under
PPM with escape method C: in a context of n bytes with q different ones, a seen byte has c / (n + q), an
unseen one the escape probability q / (n + q) times that of the next shorter context, down to the
uniform law over all 256 bytes. Statistics are frozen after training, so every (context, byte) pair has a
fixed code length per language. Pairs that were seen are kept in hashed tables, the escapes of contexts
beside them, so a text's exact code lengths are sums of look-ups; no context or byte is left out. The
language of the shortest code wins, ties going to the first in order.

Learning: at most about ``per_lang`` documents a language, a hash sample of those whose fold isn't held
out and whose lang isn't null; this alone bounds the tables. Texts are walked in slices, however long.

Edge cases: null text, or one without a letter, is ``und`` with score 0; with nothing to learn from, all
are; null and repeated ids are scored like others (a null id is in no held-out fold); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: Bytes before a text's first.
PAD = 3


#: Bytes that are walked at once.
SLICE = 1 << 18


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices (a, b, keys): the byte at each place of a to b - 1 and, above it, the three before it in its row, zeros before a row's first."""
    for a in range(0, len(data), SLICE):
        b = min(len(data), a + SLICE)
        keys = data[a:b].astype(np.uint32)
        low, high = np.searchsorted(offsets, [a - PAD, b])
        starts = offsets[low:high]
        for j in range(1, PAD + 1):
            before = np.zeros(b - a, np.uint32)
            if b > j:
                before[max(0, j - a) :] = data[max(0, a - j) : b - j]
            for t in range(j):
                at = starts + t - a
                before[at[(at >= 0) & (at < b - a)]] = 0
            keys |= before << np.uint32(8 * j)
        yield a, b, keys


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        data, offsets = common.flat_text(block.column(1))
        lang = block.column(0).dictionary_encode()
        row_lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, keys in grams(data, offsets):
            code = row_lang[np.searchsorted(offsets, np.arange(a, b), "right") - 1]
            found, n = np.unique(code << 32 | keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(found >> 32)).cast(pa.string()), pa.array(found & 0xFFFFFFFF), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, per_lang: int = 1000) -> dict | None:
    """Counts of 4-byte strings by language from the bounded sample: {"langs", "grams", "counts"}, a row per gram."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & (F.coalesce(common.doc_fold(), F.lit(0)) != 2))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 33) / F.lit(float(2**31))
    sample = known.where(drawn < share[F.col("lang")]).where("text is not null").select("lang", "text")
    counts = sample.mapInArrow(common.tidy(_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    if not counts.num_rows:
        return None
    langs = sorted(set(counts.column("lang").to_pylist()))
    grams = np.unique(counts.column("gram").to_numpy())
    table = np.zeros((len(grams), len(langs)), np.int64)
    code = counts.column("lang").combine_chunks().dictionary_encode()
    place = np.array([langs.index(x) for x in code.dictionary.to_pylist()])[code.indices.to_numpy(zero_copy_only=False)]
    table[np.searchsorted(grams, counts.column("gram").to_numpy()), place] = counts.column("n").to_numpy()
    assert spark is not None
    return {"langs": langs, "grams": grams, "counts": table}


class Table:
    """Rows of values by 32-bit keys, hashed; 0 is the row of unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = np.uint32(32 - bits)
        spot = self._spots(keys.astype(np.uint32))
        order = np.argsort(spot, kind="stable")
        self.keys = keys.astype(np.uint32)[order]
        self.values = np.concatenate([np.zeros((1, values.shape[1]), np.float32), values[order].astype(np.float32)])
        self.head = np.searchsorted(spot[order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.head).max(initial=0))

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys' rows in ``values``."""
        out = np.zeros(len(keys), np.int32)
        if not len(self.keys):
            return out
        spot = self._spots(keys)
        low, high = self.head.take(spot), self.head.take(spot + 1)
        rest = np.flatnonzero(high > low)
        for _ in range(self.deepest):
            at = low[rest]
            good = self.keys.take(at) == keys[rest]
            out[rest[good]] = at[good] + 1
            low[rest] += 1
            rest = rest[~good & (low[rest] < high[rest])]
        return out


class Model:
    """Code lengths by language. ``seen`` has those of the (context, byte) pairs of order 3 and 2, ``escape`` the escapes of contexts; orders 1 and 0 are laid out whole."""

    def __init__(self, learned: dict):
        keys3, counts3 = learned["grams"].astype(np.int64), learned["counts"]
        self.langs = learned["langs"]
        n_langs = len(self.langs)

        def shorter(keys: np.ndarray, counts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(keys & mask, return_inverse=True)
            return found, np.stack([np.bincount(at, counts[:, k], len(found)) for k in range(n_langs)], 1)

        def contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Contexts, their totals + kinds and kinds by language, and the context of each key."""
            found, at = np.unique(keys >> 8, return_inverse=True)
            total = np.stack([np.bincount(at, counts[:, k], len(found)) for k in range(n_langs)], 1)
            kinds = np.stack([np.bincount(at, counts[:, k] > 0, len(found)) for k in range(n_langs)], 1)
            return found, total + kinds, kinds, at

        def chances(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray):
            """Probabilities of seen pairs, given those by the shorter context; contexts and their escape probabilities."""
            found, whole, kinds, at = contexts(keys, counts)
            escape = np.where(whole > 0, kinds / np.maximum(whole, 1), 1.0)
            return np.where(counts > 0, counts / np.maximum(whole[at], 1), escape[at] * lower), found, escape

        # order 0 and 1 in full
        keys0, counts0 = shorter(keys3, counts3, 0xFF)
        whole, kinds = counts0.sum(0) + (counts0 > 0).sum(0), (counts0 > 0).sum(0)
        p0 = np.tile(np.where(whole > 0, kinds / np.maximum(whole, 1), 1.0) / 256, (256, 1))
        p0[keys0] = np.where(counts0 > 0, counts0 / np.maximum(whole, 1), p0[keys0])
        keys1, counts1 = shorter(keys3, counts3, 0xFFFF)
        seen1, found1, escape1 = chances(keys1, counts1, p0[keys1 & 0xFF])
        p1 = np.tile(p0, (256, 1)).reshape(256, 256, n_langs)
        p1[found1] *= escape1[:, None, :]
        p1 = p1.reshape(65536, n_langs)
        p1[keys1] = seen1
        keys2, counts2 = shorter(keys3, counts3, 0xFFFFFF)
        p2, found2, escape2 = chances(keys2, counts2, p1[keys2 & 0xFFFF])
        p3, found3, escape3 = chances(keys3, counts3, p2[np.searchsorted(keys2, keys3 & 0xFFFFFF)])
        self.one = -np.log2(p1).astype(np.float32)
        self.seen = {3: Table(keys3, -np.log2(p3)), 2: Table(keys2, -np.log2(p2))}
        self.escape = {3: Table(found3, -np.log2(escape3)), 2: Table(found2, -np.log2(escape2))}

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of bytes behind their contexts (places x languages)."""
        row = self.seen[3].rows(keys)
        out = self.seen[3].values[row]
        rest = np.flatnonzero(row == 0)
        if len(rest):
            out[rest] = self.escape[3].values[self.escape[3].rows(keys[rest] >> np.uint32(8))]
            short = keys[rest] & np.uint32(0xFFFFFF)
            row = self.seen[2].rows(short)
            out[rest] += self.seen[2].values[row]
            rest, short = rest[row == 0], short[row == 0]
            out[rest] += self.escape[2].values[self.escape[2].rows(short >> np.uint32(8))] + self.one[(short & np.uint32(0xFFFF)).astype(np.int64)]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits, rows x languages."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a, b, keys in grams(data, offsets):
            first, last = np.searchsorted(offsets, [a, b - 1], "right") - 1
            bounds = np.clip(offsets[first : last + 2], a, b) - a
            full = np.flatnonzero(np.diff(bounds))
            out[first + full] += np.add.reduceat(self.bits(keys), bounds[full], axis=0, dtype=np.float64)
        return out


def predict(docs: DataFrame, learned: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    common.ship(docs.sparkSession)
    sent, name = docs.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if sent.value is None else common.latest("ppm", name, lambda: Model(sent.value))
        for block in common.blocks(batches):
            data, offsets = common.flat_text(block.column(1))
            letters = common.sums(LETTER[data], offsets) > 0
            for k in np.flatnonzero(~letters & (common.sums(data >= 128, offsets) > 0)).tolist():
                letters[k] = any(ch.isalpha() for ch in block.column(1)[k].as_py())
            if model is None:
                names, score = ["und"] * len(letters), np.zeros(len(letters))
            else:
                lengths = model.lengths(data, offsets)
                best = lengths.argmin(1)
                score = np.where(letters, 1 / np.exp2(np.maximum(lengths.min(1, keepdims=True) - lengths, -1000)).sum(1), 0.0)
                names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(common.tidy(run), source.drop("text").schema.add("lang_pred", "string").add("score", "double"))


def op7_ppm_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.ship(spark)
    got = predict(docs, train(docs))
    return got.select("doc_id", (F.coalesce(common.doc_fold(), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
