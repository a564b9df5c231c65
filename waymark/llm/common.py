"""What the operators of this subpackage share: settled tables, shipped code, joins and word splitting.

A settled table is a Parquet table in the folder that all executors share. It cuts lineage, gives
Catalyst true sizes and outlives lost executors. The folder is the session's
``spark.checkpoint.dir``; only where that is unset and the session is local (tests) a temporary one is made.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Text that a worker handles at once, in bytes (a single longer document is handled alone).
BLOCK_BYTES = 2 << 20
#: The session's limit for an Arrow batch in bytes, and Spark's own value of it.
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


# ---------------------------------------------------------------- shared folder and settled tables


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; the driver's JVM removes it when it ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        top = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", top)
        atexit.register(shutil.rmtree, top.removeprefix("file://"), ignore_errors=True)
    folder = f"{top.rstrip('/')}/waymark-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_waymark_folder", None) != folder:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        spark.sparkContext._waymark_folder = folder
    return folder


def settled_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a settled table or an archive that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back; ``.settled_at`` holds the path."""
    spark = df.sparkSession
    path = settled_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that workers import it anywhere.

    Where the session has no limit of its own for an Arrow batch, it gets a small one: executors and workers hold
    several batches at once.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, DEFAULT_BATCH).removesuffix("b") == DEFAULT_BATCH:
        spark.conf.set(BATCH, str(2 * BLOCK_BYTES))
    if getattr(sc, "_waymark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="waymark-zip-")
    archive = os.path.join(folder, "waymark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("waymark", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._waymark_shipped = True


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for file scans the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def from_files(df: DataFrame) -> bool:
    """Whether df is no more than columns and rows of files, which come in the same order whenever they are read."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "DataSourceV2ScanRelation")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The size of a table's files where Catalyst knows it, else the bytes of its texts, counted."""
    known = plan_bytes(df)
    if known < 1 << 50:
        return known
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first()["n"])


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = 2 << 20) -> DataFrame:
    """Joins a settled right side: broadcast if its files are below ``most``, else shuffled.

    Both sides of the shuffled form come straight from scans, so adaptive execution can split a
    hot key's partition.
    """
    return left.join(F.broadcast(right) if plan_bytes(right) <= most else right, on, how)


def doc_fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out from learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")), F.lit(4))


# ---------------------------------------------------------------- Arrow text


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def to_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A large_binary (or given) array over bytes and int64 offsets, without a copy."""
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each holds about ``most`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat_text(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Joins successive slices into tables of about ``most`` text bytes."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in blocks(batches, column, most):
        grow = batch.column(batch.schema.get_field_index(column)).nbytes
        if kept and size + grow > most:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, size = [], 0
        kept.append(batch)
        size += grow
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def one(table: pa.Table, column: str) -> pa.Array:
    got = table.column(column)
    return got.chunk(0) if got.num_chunks == 1 else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a block.

    ``data``/``ends`` are the words' bytes and end offsets, ``starts`` their places in the block,
    ``first`` (n + 1) the number of the first word of each row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = SPACE[data]
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            before[inner] = True
            after[inner - 1] = True
        solid = ~space
        self.solid = solid
        self.starts = np.flatnonzero(solid & before)
        self.lengths = np.flatnonzero(solid & after) + 1 - self.starts
        self.ends = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = data.take(np.flatnonzero(solid))
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def array(self, data: np.ndarray | None = None) -> pa.Array:
        return to_array(self.bytes if data is None else data, self.ends)

    def codes(self, data: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """Exact dictionary codes of the words, and the dictionary."""
        coded = self.array(data).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def codes_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense codes of int64 values, and how many there are."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values; used on dictionaries, so once per distinct word of a block."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words.to_pylist()), np.uint64, len(words))


def once(name: str, make):
    """A value that a Python process makes once and keeps."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def latest(slot: str, name: str, make):
    """Like once, but of all names of a slot only the latest is kept."""
    if _KEPT.get(slot, ("",))[0] != name:
        _KEPT.pop(slot, None)
        _KEPT[slot] = (name, make())
    return _KEPT[slot][1]


_KEPT: dict[str, object] = {}


def tidy(run):
    """A mapInArrow function that leaves little behind: workers are used again by other operators, and an executor's memory holds all of them.

    What another operator's functions kept is forgotten at the start, and free memory goes back to the system
    at the end.
    """
    owner = run.__module__

    def wrapped(batches):
        enter(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def enter(owner: str) -> None:
    """Forgets what the functions of other modules kept."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner


def release() -> None:
    """Gives free memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def packed(value: np.ndarray | bytes, level: int = 1) -> bytes:
    import zstandard

    return once(f"zstd{level}", lambda: zstandard.ZstdCompressor(level)).compress(value.tobytes() if isinstance(value, np.ndarray) else value)


def unpacked(value: bytes) -> bytes:
    import zstandard

    return once("unzstd", zstandard.ZstdDecompressor).decompress(value)


def planes(values: np.ndarray) -> bytes:
    """Unsigned values below 2^32 as compressed byte planes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return bytes([width]) + packed(np.ascontiguousarray(raw[:, :width].T))


def unplanes(value: bytes) -> np.ndarray:
    width = value[0]
    raw = np.frombuffer(unpacked(value[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u4")


def list_take(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the lists ``values[offsets[c]:offsets[c + 1]]`` of successive codes; and the n + 1 bounds."""
    size = np.diff(offsets)[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat((offsets[:-1][codes] - ends[:-1]).astype(np.int32 if ends[-1] < 2**31 and len(values) < 2**31 else np.int64), size)
    at += np.arange(ends[-1], dtype=at.dtype)
    return values[at], ends


def concat_binary(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
