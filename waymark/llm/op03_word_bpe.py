"""BPE encoding and decoding through a distinct-word table.

Texts are split at the six ASCII spaces into words. The tokenizer's normaliser and splitter never look
across such a space, so the ids of a text are the ids of its words in order, and each distinct word is
encoded once.

1. ``split``: every chunk of about ``chunk_bytes`` of text becomes one sequence row (its documents' word
   numbers) and one row for each bucket of its distinct words; a word's bucket is its hash's.
2. ``encode``: a group of all rows of a bucket is that part of the distinct-word table; its distinct words
   are encoded once, and each chunk gets back the ids of its words. A word comes at most once from a
   chunk, so frequent words don't make a bucket hot. Buckets grow in number with the input; from 256 GB
   on, when their rows would become too small, a bucket is split by chunks instead, so a group stays bounded.
3. ``join``: a chunk's sequence row and its encoded rows meet again, and ids are put in place by position.

Decoding joins ids to their pieces (the vocabulary has a fixed size) and joins pieces by one space, as
the library does for a tokenizer without a decoder.

Edge cases: null and empty texts have no ids and decode to the empty text; repeated rows each give a row;
extra columns are ignored; null ids are kept; an empty table gives an empty result; a document longer
than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK_BYTES = 16 << 20
#: Bytes of input whose distinct words of a bucket meet in one group.
BUCKET_BYTES = 256 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def load():
        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        return t

    return common.once(f"tokenizer {path}", load)


def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the pieces by id, each followed by a space; and which ids exist."""

    def load():
        t = tokenizer(path)
        n = t.get_vocab_size(with_added_tokens=True)
        found = [t.id_to_token(i) for i in range(n)]
        raw = [b"" if x is None else x.encode() + b" " for x in found]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.array([x is not None for x in found])

    return common.once(f"pieces {path}", load)


def decode_rows(ids: np.ndarray, bounds: np.ndarray, path: str) -> list[bytes]:
    """The decoded text of each row in UTF-8: the id-to-piece join, pieces parted by a space."""
    raw, ends, _ = pieces(path)
    table = common.to_array(raw, ends)
    text = table.take(pa.array(ids, pa.int64())) if len(ids) else pa.array([], pa.large_binary())
    data, offsets = common.flat_text(text)
    view, at = memoryview(data), offsets[bounds]
    return [bytes(view[a : max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def decimal_rows(ids: np.ndarray, bounds: np.ndarray, size: int) -> list[bytes]:
    """The decimal ids of each row, parted by a space."""

    def load():
        raw = [b"%d " % i for i in range(size)]
        return common.to_array(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    table = common.once(f"decimals {size}", load)
    data, offsets = common.flat_text(table.take(pa.array(ids, pa.int64())) if len(ids) else pa.array([], pa.large_binary()))
    view, at = memoryview(data), offsets[bounds]
    return [bytes(view[a : max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _split(buckets: int, chunk_bytes: int):
    import xxhash

    def flush(chunk: int, keys: list[pa.Array], codes: list[np.ndarray], words: list[pa.Array], counts: list[np.ndarray]):
        # one dictionary for the chunk's blocks
        sizes = np.cumsum([0, *map(len, words)])
        joined = common.concat_binary(words).dictionary_encode()
        unified = joined.indices.to_numpy(zero_copy_only=False)
        code = np.concatenate([unified[a:b][c] for c, a, b in zip(codes, sizes[:-1], sizes[1:], strict=True)]) if codes else np.zeros(0, np.int32)
        listed = joined.dictionary.to_pylist()
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in listed), np.int64, len(listed))
        often = np.bincount(code, minlength=len(listed))
        # within a bucket frequent words come first, so that places are small numbers
        order = np.lexsort((-often, bucket))
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - first[bucket[order]]
        sorted_words = joined.dictionary.take(pa.array(order))
        # both readings of the input must cut the same chunks: the stamp goes both ways and is compared
        stamp = xxhash.xxh3_64_intdigest(joined.dictionary.buffers()[2] or b"", len(code)) >> 1
        rows = [{"chunk": chunk, "bucket": -1, "keys": pa.concat_arrays(keys), "words": b"", "places": common.planes(place[code]), "homes": common.planes(bucket[code]), "counts": common.planes(np.concatenate(counts))}]
        data, ends = common.flat_text(sorted_words)
        for b in np.flatnonzero(np.diff(first)).tolist():
            part = ends[first[b] : first[b + 1] + 1]
            rows.append({"chunk": chunk, "bucket": b, "keys": None, "words": common.packed(data[part[0] : part[-1]], 3), "places": common.planes(np.diff(part)), "homes": b"", "counts": b""})
        return [r | {"stamp": stamp} for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        held: tuple[list, list, list, list] = ([], [], [], [])
        size, kind = 0, pa.null()

        def out():
            rows = flush(base + number, *held)
            keys = pa.array([None if r["keys"] is None else 0 for r in rows], pa.int8())
            listed = pa.ListArray.from_arrays(pa.array([0, *([len(rows[0]["keys"])] * len(rows))], pa.int32()), rows[0]["keys"])
            assert len(keys) == len(listed)
            return pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["stamp"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), listed, *[pa.array([r[c] for r in rows], pa.binary()) for c in ("words", "places", "homes", "counts")]], names=["chunk", "stamp", "bucket", "keys", "words", "places", "homes", "counts"])

        for block in common.blocks(batches):
            data, offsets = common.flat_text(block.column(1))
            if size and size + len(data) > chunk_bytes:
                yield out()
                number, size, held = number + 1, 0, ([], [], [], [])
            words = common.Words(data, offsets)
            code, table = words.codes()
            kind = block.column(0).type
            for to, what in zip(held, (block.column(0), code, table, words.counts), strict=True):
                to.append(what)
            size += len(data)
        if held[0]:
            yield out()
        assert kind is not None

    return run


def _encode(path: str):
    def run(table: pa.Table) -> pa.Table:
        t = tokenizer(path)
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        lengths = [common.unplanes(x) for x in table.column("places").to_pylist()]
        raw = b"".join(common.unpacked(x) for x in table.column("words").to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
        coded = common.to_array(np.frombuffer(raw, np.uint8), ends).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        values, sizes = [], []
        for at in range(0, len(distinct), 4096):
            for e in t.encode_batch_fast([w.decode("utf-8", "replace") for w in distinct[at : at + 4096]], add_special_tokens=False):
                ids = e.ids
                sizes.append(len(ids))
                values.extend(ids)
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        values = np.array(values, np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, counts, at = [], [], 0
        for n in map(len, lengths):
            got, ends = common.list_take(values, bounds, codes[at : at + n])
            ids.append(common.planes(got))
            counts.append(common.planes(np.diff(ends)))
            at += n
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "stamp": table.column("stamp"), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _join(fn: Callable, buckets: int):
    def run(sequences: pa.Table, encoded: pa.Table) -> pa.Table:
        if len({*sequences.column("stamp").to_pylist(), *encoded.column("stamp").to_pylist()}) > 1:
            raise RuntimeError("the input gave its rows in another order when it was read again; settle it first")
        ids, sizes, first = [], [], np.zeros(buckets, np.int64)
        seen = 0
        for b, i, n in zip(*[encoded.column(c).to_pylist() for c in ("bucket", "ids", "counts")], strict=True):
            ids.append(common.unplanes(i).astype(np.int32))
            sizes.append(common.unplanes(n))
            first[b] = seen
            seen += len(sizes[-1])
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]) if sizes else np.zeros(1, np.int64)
        out = []
        for keys, place, home, count in zip(sequences.column("keys").combine_chunks(), *[sequences.column(c).to_pylist() for c in ("places", "homes", "counts")], strict=True):
            code = first[common.unplanes(home)] + common.unplanes(place)
            got, ends = common.list_take(values, bounds, code)
            rows = ends[np.concatenate([[0], np.cumsum(common.unplanes(count), dtype=np.int64)])]
            out.append(pa.Table.from_arrays([keys.values, *fn(got, rows)[0]], names=["doc_id", *fn.names]))
        return pa.concat_tables(out)

    return run


class _Emit:
    """A named function from (ids, row bounds) to columns; ``names`` are theirs."""

    def __init__(self, names: list[str], make: Callable):
        self.names, self.make = names, make

    def __call__(self, ids, rows):
        return (self.make(ids, rows),)


def encode_with(docs: DataFrame, emit: _Emit, schema: str, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """A row per row of docs: doc_id and the columns that ``emit`` makes of its ids."""
    common.ship(docs.sparkSession)
    path = path or vocabulary()
    size = common.text_bytes(docs, text)
    buckets = buckets or max(8, min(32768, size // (8 << 20)))
    parts = max(1, -(-size // (buckets * BUCKET_BYTES)))
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = slim.schema["doc_id"].dataType
    split_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("stamp", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("words", "places", "homes", "counts")]])
    if not common.from_files(slim):
        slim = common.settle(slim, "texts")  # else rows may come in another order when they are read again
    # read twice, once for the words and once for the sequences: dearer by one split, but without a second copy of the sequences on disk
    split = slim.mapInArrow(common.tidy(_split(buckets, chunk_bytes)), split_schema)
    sequences = split.where("bucket < 0").drop("words", "bucket")
    encoded = split.where("bucket >= 0").select("chunk", "stamp", "bucket", "words", "places").groupBy("bucket", F.pmod(F.xxhash64("chunk"), F.lit(parts))).applyInArrow(_encode(path), "chunk long, stamp long, bucket int, ids binary, counts binary")
    out = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(schema).fields])
    return sequences.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_join(emit, buckets), out)


def encode(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def lists(ids, rows):
        return [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))]

    return encode_with(docs, _Emit(["ids"], lists), "ids array<int>", path, **options)


def decode(encoded: DataFrame, path: str | None = None, *, ids: str = "ids") -> DataFrame:
    """Adds ``text``: pieces of the ids, joined by a space. Null ids give the empty text, unknown ids nothing."""
    common.ship(encoded.sparkSession)
    path = path or vocabulary()
    rest = [c for c in encoded.columns if c not in (ids, "text")]
    source = encoded.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        known = pieces(path)[2]
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, counts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
            good = (values >= 0) & (values < len(known))
            good[good] = known[values[good]]
            bounds = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(counts)])]
            text = pa.array([x.decode() for x in decode_rows(values[good], bounds, path)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*rest, "text"])

    return source.mapInArrow(common.tidy(run), source.drop("__ids").schema.add("text", "string"))


def digests(path: str) -> _Emit:
    def make(ids, rows):
        size = len(pieces(path)[2])
        sha = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
        return [pa.array(np.diff(rows), pa.int64()), sha(decimal_rows(ids, rows, size)), sha(decode_rows(ids, rows, path))]

    return _Emit(["n_tokens", "ids_sha256", "decoded_sha256"], make)


def op3_word_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests; both are made by the operator's own encode and decode."""
    path = vocabulary()
    return encode_with(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests(path), "n_tokens long, ids_sha256 string, decoded_sha256 string", path)
