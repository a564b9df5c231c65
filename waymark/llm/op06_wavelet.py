"""Token ids of all documents in files of wavelet matrices.

Documents are dealt out in ranges of doc_id, a file for each range. A range's texts are split where the
byte-level tokenizer's splitter always splits, each distinct piece of a range is encoded once, and ids are
put in place; an end id follows each document. A file is a row of segments of at most ``SEGMENT`` ids.
A segment holds its documents' ids and lengths and a wavelet matrix: for each bit, from the top, the bits of
all ids in an order where those with zero come first at every level. Rank and select on these planes
give access, counts and places of an id (class ``Wavelet``) from the compressed file alone.

All pieces are encoded with the tokenizers library. Plain ones are joined to longer texts for its calls: each
begins with one space and ends in none, so the library splits there again, and the ids' lengths in bytes,
which the vocabulary tells, part them.

Segment: ``WVM1``, the length of the rest (8 bytes), a header of JSON after its length (4 bytes), planes,
and a line feed. Integers are little-endian. Segments can be skipped by their length.

Edge cases: null and empty texts have the end id alone; repeated rows are documents of their own; null
doc_ids come first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .op03_word_bpe import tokenizer

SEGMENT = 1 << 19
CHUNK_BYTES = 8 << 20
#: Bytes of plain pieces that are encoded in one call.
JOINED = 4096
MAGIC = b"WVM1"
#: First bytes behind a space before which no cut is made: other white space may begin there, or a special token.
UNSURE = np.zeros(256, bool)
UNSURE[[0xC2, 0xE1, 0xE2, 0xE3, 0x3C]] = True
UNSURE[common.SPACE] = True
#: Letters of ASCII and marks behind them at which their run ends, whatever follows (an apostrophe may begin a contraction).
LETTERS, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
MARKS[list(b",.;:!?)\"")] = True


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lengths(path: str) -> np.ndarray:
    """How many bytes an id stands for: a character of a byte-level vocabulary is a byte. Tokenizers that split otherwise are refused."""

    def load():
        t = tokenizer(path)
        made = json.loads(t.to_str())
        if made["normalizer"] or made["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": made["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
            raise ValueError(f"{path}: pieces are cut for byte-level tokenizers without a normaliser")
        if any(not x["content"].startswith("<|") or MARKS[list(x["content"].encode())].any() for x in made["added_tokens"]):
            raise ValueError(f"{path}: pieces may cut an added token")
        found = [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
        return np.array([0 if x is None else len(x) for x in found], np.int64)

    return common.once(f"lengths {path}", load)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of pieces, each within a row, at whose bounds the splitter always splits: before the last of successive spaces, unless what follows is unsure, and between a letter and a mark."""
    at = np.zeros(len(data) + 1, bool)
    if len(data):
        space = common.SPACE.take(data)
        np.logical_and(space[:-1], ~UNSURE.take(data[1:]), out=at[: len(data) - 1])
        ends = offsets[1:][offsets[1:] > 0] - 1
        at[ends] = False
        at[1:-1] |= LETTERS.take(data[:-1]) & MARKS.take(data[1:])
    at[offsets] = True
    return np.flatnonzero(at)


def encode_distinct(pieces: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, and their n + 1 bounds."""
    t, length = tokenizer(path), _lengths(path)
    data, ends = common.flat_text(pieces)
    n = len(pieces)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.diff(ends)
    begin = ends[:-1]
    # joined, a piece that begins with one space and ends in none stays as it is; others are encoded alone
    plain = size > 1
    two = np.minimum(begin + 1, len(data) - 1)
    plain &= common.SPACE[data[np.minimum(begin, len(data) - 1)]] & ~common.SPACE[data[np.maximum(ends[1:] - 1, 0)]] & ~UNSURE[data[two]]
    special = np.zeros(len(data), bool)
    special[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    plain &= common.sums(special, ends) == 0
    counts = np.zeros(n, np.int64)
    some = np.flatnonzero(plain)
    values = []
    if len(some):
        text, text_ends = common.flat_text(pieces.take(pa.array(some)))
        groups = np.unique(np.searchsorted(text_ends, np.arange(0, len(text), JOINED)))
        bounds = np.append(text_ends[groups], len(text)) if groups[-1] < len(some) else text_ends[groups]
        raw = text.tobytes()
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in t.encode_batch_fast(parts, add_special_tokens=False)])
        token_ends = np.cumsum(length[ids])
        bound = np.searchsorted(token_ends, text_ends[1:])
        assert token_ends[-1] == len(text) and (token_ends[bound] == text_ends[1:]).all(), "a token crosses a piece's bound"
        counts[some] = np.diff(bound + 1, prepend=0)
        values.append(ids)
    odd = np.flatnonzero(~plain)
    if len(odd):
        for e in t.encode_batch_fast([x.decode("utf-8", "replace") for x in pieces.take(pa.array(odd)).to_pylist()], add_special_tokens=False):
            values.append(np.array(e.ids, np.int64))
            counts[odd[len(values) - 1 - (len(some) > 0)]] = len(e.ids)
    # the plain pieces' ids come first, then those of the others: put them in the pieces' order
    order = np.concatenate([some, odd])
    put = np.concatenate([[0], np.cumsum(counts[order])])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return common.list_take(np.concatenate(values), put, place)


class Encoder:
    """Encodes texts, each distinct piece once as long as the encoder lives."""

    def __init__(self, path: str):
        self.path, self.pieces = path, pa.array([], pa.large_binary())
        self.values, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rows(self, text: pa.Array, end: int | None = 2) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id behind, and the rows' n + 1 bounds."""
        data, offsets = common.flat_text(text)
        at = cuts(data, offsets)
        coded = common.to_array(data, at).dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.pieces)
        new = coded.dictionary.filter(place.is_null())
        values, bounds = encode_distinct(new, self.path)
        known = len(self.pieces)
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = np.arange(known, len(self.pieces))
        got, ends = common.list_take(self.values, self.bounds, place[coded.indices.to_numpy(zero_copy_only=False)])
        rows = ends[np.searchsorted(at, offsets)]
        if end is None:
            return got, rows
        n = len(rows) - 1
        out = np.full(len(got) + n, end, np.int32)
        keep = np.ones(len(out), bool)
        keep[rows[1:] + np.arange(n)] = False
        out[keep] = got
        return out, rows + np.arange(n + 1)


# ---------------------------------------------------------------- wavelet matrix


class Wavelet:
    """A wavelet matrix: planes of packed bits, with rank and select by popcounts of 64-bit words."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n = planes, n
        self._dirs: list | None = None

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> Wavelet:
        now, out = ids.astype(np.uint16 if width <= 16 else np.uint32), []
        for level in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << level)) != 0
            out.append(np.packbits(bit, bitorder="little"))
            if level:
                now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
        return cls(out, len(ids))

    def all(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each level's order is undone."""
        width = len(self.planes)
        now = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for k in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            if k < width - 1:
                back = np.empty_like(now)
                zeros = self.n - int(np.count_nonzero(bit))
                back[np.flatnonzero(~bit)] = now[:zeros]
                back[np.flatnonzero(bit)] = now[zeros:]
                now = back
            now |= bit.astype(now.dtype) << now.dtype.type(width - 1 - k)
        return now

    def _directories(self):
        """Per plane: words, ones before each word, and the number of zeros."""
        if self._dirs is None:
            self._dirs = []
            for p in self.planes:
                words = np.frombuffer(p.tobytes() + bytes(-len(p) % 8 + 8), "<u8")
                before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
                self._dirs.append((words, before, self.n - int(before[-1])))
        return self._dirs

    @staticmethod
    def _ones(words, before, at: int) -> int:
        return int(before[at >> 6]) + (int(words[at >> 6]) & ((1 << (at & 63)) - 1)).bit_count()

    def access(self, at: int) -> int:
        value = 0
        for words, before, zeros in self._directories():
            bit, ones = (int(words[at >> 6]) >> (at & 63)) & 1, self._ones(words, before, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for k, (words, before, zeros) in enumerate(self._directories()):
            a, b = self._ones(words, before, start), self._ones(words, before, stop)
            start, stop = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token occurs in a range of places (rank is count from 0)."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0; -1 without one."""
        if not 0 <= k < self.count(token):
            return -1
        at = self._range(token, 0, 0)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            words, before, zeros = self._directories()[level]
            bit = token >> (len(self.planes) - 1 - level) & 1
            want = at - zeros if bit else at
            ones = before if bit else np.arange(len(before)) * 64 - before
            w = int(np.searchsorted(ones, want, "right")) - 1
            rest, word = want - int(ones[w]), int(words[w]) if bit else ~int(words[w]) & (2**64 - 1)
            for _ in range(rest):
                word &= word - 1
            at = w * 64 + (word & -word).bit_length() - 1
        return at


def segment(keys: list, lengths: np.ndarray, ids: np.ndarray, shard: int, number: int) -> bytes:
    """A segment's bytes. A document that goes on in the next segment has a part in each."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    body = common.packed(b"".join(p.tobytes() for p in Wavelet.build(ids, width).planes))
    head = json.dumps({"shard": shard, "number": number, "n": len(ids), "width": width, "keys": keys, "lengths": lengths.tolist()}).encode()
    head = common.packed(head, 3)
    rest = struct.pack("<I", len(head)) + head + body + b"\n"
    return MAGIC + struct.pack("<Q", len(rest)) + rest


def open_segments(data: bytes) -> Iterator[tuple[dict, Wavelet]]:
    """The segments of a file: their headers and wavelet matrices."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        (size,) = struct.unpack_from("<Q", data, at + 4)
        rest = memoryview(data)[at + 12 : at + 12 + size]
        if len(rest) < size or rest[-1] != 0x0A:
            raise ValueError(f"the segment at byte {at} is cut short")
        (n,) = struct.unpack_from("<I", rest)
        head = json.loads(common.unpacked(bytes(rest[4 : 4 + n])))
        raw, step = np.frombuffer(common.unpacked(bytes(rest[4 + n : -1])), np.uint8), (head["n"] + 7) // 8
        yield head, Wavelet([raw[k * step : (k + 1) * step] for k in range(head["width"])], head["n"])
        at += 12 + size


# ---------------------------------------------------------------- Spark


def write_tokens(docs: DataFrame, path: str, tokens: str | None = None, *, doc_id: str = "doc_id", text: str = "text", end: int = 2, shard_bytes: int = 12 << 20) -> None:
    """Writes a file for each range of doc_id, about ``shard_bytes`` of the input's files each."""
    common.ship(docs.sparkSession)
    tokens = tokens or vocabulary()
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    shards = max(1, min(1 << 20, -(-common.text_bytes(docs, text) // shard_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def out():
            made = segment([k for some in keys for k in some], np.concatenate(lengths), np.concatenate(ids), shard, number)
            return pa.RecordBatch.from_arrays([pa.array([made[:-1]], pa.binary())], names=["segment"])

        encoder = Encoder(tokens)  # the distinct pieces of a shard, which is bounded
        for table in common.gathered(batches, most=CHUNK_BYTES):
            got, rows = encoder.rows(common.one(table, "text"), end)
            names = common.one(table, "doc_id").to_pylist()
            at = 0
            while at < len(names):
                room = SEGMENT - held
                to = int(np.searchsorted(rows, rows[at] + room, "right")) - 1
                if to > at:
                    keys.append(names[at:to])
                    lengths.append(np.diff(rows[at : to + 1]))
                    ids.append(got[rows[at] : rows[to]])
                    held += int(rows[to] - rows[at])
                    at = to
                elif held:
                    yield out()
                    keys, lengths, ids, held, number = [], [], [], 0, number + 1
                else:  # a document longer than a segment: parts, of which only the last closes it
                    whole = got[rows[at] : rows[at + 1]]
                    for k in range(0, len(whole), SEGMENT):
                        part = whole[k : k + SEGMENT]
                        last = k + SEGMENT >= len(whole)
                        keys, lengths, ids = [[names[at] if last else {"part": names[at]}]], [np.array([len(part)])], [part]
                        yield out()
                        keys, lengths, ids, number = [], [], [], number + 1
                    at += 1
        if held:
            yield out()

    # rows without an id, or with the same one, are parted by their texts
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    dealt.mapInArrow(common.tidy(run), "segment binary").select(F.col("segment").cast("string").alias("value")).write.options(lineSep="\n", compression="none").text(path)


def read_tokens(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """shard, number (the document's within its shard), doc_id, n_tokens, ids_crc32 and, if asked for, ids, from the files below path."""
    common.ship(spark)

    def rows(data: bytes):
        """Documents in order, with parts of long ones joined."""
        carry: list[np.ndarray] = []
        number = 0
        for head, matrix in open_segments(data):
            whole = matrix.all()
            ends = np.concatenate([[0], np.cumsum(head["lengths"], dtype=np.int64)])
            names, parts = [], []
            for key, a, b in zip(head["keys"], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = whole[a:b]
                if isinstance(key, dict):
                    carry.append(part)
                    continue
                names.append(key)
                parts.append(np.concatenate([*carry, part]) if carry else part)
                carry = []
            yield head["shard"], number, names, parts
            number += len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard, number, names, parts in rows(content.as_py()):
                    n = len(names)
                    wide = [np.ascontiguousarray(p, "<u4") for p in parts]
                    columns = [pa.array([shard] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array(names, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in wide], pa.int64())]
                    if ids:
                        columns.append(pa.array([p.astype(np.int32) for p in wide], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "number", "doc_id", "n_tokens", "ids_crc32", *["ids"] * ids])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(common.tidy(run), "shard int, number long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def look_up(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Per shard and segment: how often the token occurs and its places, by rank and select; a segment bounds a row."""
    common.ship(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for head, matrix in open_segments(content.as_py()):
                    n = matrix.count(token)
                    row = (head["shard"], head["number"], n, [matrix.select(token, k) for k in range(n)])
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["shard", "segment", "n", "places"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(common.tidy(run), "shard int, segment int, n long, places array<long>")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before: a running sum within each shard and over the shards' totals."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # a row a shard: small beside the documents, and the only rows that meet in one task
    before = totals.select("shard", (F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("number").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.join(before, "shard").withColumn("start", F.col("before") + within).drop("before")


def op6_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    path = common.settled_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = common.settle(read_tokens(spark, path, ids=False), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
