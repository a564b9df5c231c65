"""Near-duplicates by circulant MinHash with exact verification.

A document's set is its distinct shingles of ``shingle`` words (A-Z in lower case); a shorter text's is
its whole word sequence, an empty one's is empty and linked with nothing. Documents are linked at a
Jaccard similarity of ``percent`` or more.

1. Documents of equal sets form a class; the rest works on classes, named by their smallest doc_id.
2. Signatures are circulant: one permutation of the 32-bit codes, sigma, scatters the shingles; coordinate
   k is the least pi(sigma(x) + k mod 2^32) over the set, with one second permutation pi, shifted.
   ``bands`` bands of ``rows`` coordinates make the buckets: 40 of 6 miss a pair at 0.8 once in 200,000.
3. Stars: every member of a bucket is paired with the bucket's pivot (a pseudo-random member, another one
   in each band). The best three pivots of each member, by signature, are verified on full sets.
   Components follow.
4. The rest, exactly: in each bucket that still spans several components, the members outside its largest
   component are compared by signature with all of the bucket in blocks of bounded size; where pairs of
   different components come near the threshold (five standard deviations of the signature's
   estimate), their full sets join the block and are compared. Only links leave a block, one for two
   components that it shows to be one. Components again.

Nothing is dropped or capped; pairs within a component are skipped, as they can't change a result. Hot
buckets are split by salts, hot sets by adaptive skew joins of settled tables.

Edge cases: null ids stay apart from each other, with a null component, kept; repeated rows are equal
sets; texts equal up to white space and A-Z case are equal sets; extra columns are ignored here; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS, ROWS = 40, 6
#: Most members, and most probes, that meet in one block of a bucket.
BLOCK = 1024


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit codes."""
    x = x.astype(np.uint32, copy=True)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the distinct shingles of each row, row after row, and the n + 1 bounds."""
    data, offsets = common.flat_text(text)
    words = common.Words(data, offsets)
    rows = len(offsets) - 1
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    code, table = words.codes(common.LOWER[words.bytes])
    names = common.hash_words(table)
    code, size = code.astype(np.int64), len(names)
    # windows grow by a word at a time; a window's code is exact within the block
    now, hashes = code, common.mix64(names)
    row = words.row()
    for k in range(1, shingle):
        coded = pa.array(now[: len(code) - k] * size + code[k:]).dictionary_encode()
        pairs = coded.dictionary.to_numpy(zero_copy_only=False)
        hashes = common.mix64(hashes[pairs // size] * np.uint64(0x9E3779B97F4A7C15) + names[pairs % size])
        now = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    inside = np.flatnonzero(row[: len(now)] == row[shingle - 1 :]) if len(now) else np.zeros(0, np.int64)
    keys = pa.array(row[inside] * max(1, len(hashes)) + now[inside]).unique().to_numpy(zero_copy_only=False)
    set_rows, set_codes = keys // max(1, len(hashes)), hashes[keys % max(1, len(hashes))] if len(hashes) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    if len(short):
        extra = []
        for r in short.tolist():
            h = np.uint64(words.counts[r])
            for c in code[words.first[r] : words.first[r + 1]]:
                h = common.mix64(np.array([h]) * np.uint64(0x9E3779B97F4A7C15) + names[c : c + 1])[0]
            extra.append(h)
        set_rows = np.concatenate([set_rows, short])
        set_codes = np.concatenate([set_codes, np.array(extra, np.uint64)])
        order = np.argsort(set_rows, kind="stable")
        set_rows, set_codes = set_rows[order], set_codes[order]
    return set_codes, np.searchsorted(set_rows, np.arange(rows + 1))


def signatures(codes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash coordinates (rows x size); every row has a shingle."""
    out = np.empty((len(bounds) - 1, size), np.uint32)
    scattered = sigma((codes >> np.uint64(32)).astype(np.uint32))
    at = 0
    while at < len(bounds) - 1:  # slices that stay in cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 60000, "right")) - 1)
        part = scattered[bounds[at] : bounds[to]]
        first = bounds[at:to] - bounds[at]
        t, u = np.empty_like(part), np.empty_like(part)
        for k in range(size):
            np.add(part, np.uint32(k), out=t)
            np.right_shift(t, np.uint32(16), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, np.uint32(0x7FEB352D), out=t)
            np.right_shift(t, np.uint32(15), out=u)
            np.bitwise_xor(t, u, out=t)
            np.multiply(t, np.uint32(0x846CA68B), out=t)
            np.right_shift(t, np.uint32(16), out=u)
            np.bitwise_xor(t, u, out=t)
            out[at:to, k] = np.minimum.reduceat(t, first)
        at = to
    return out


def _signed(bands: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (common.mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1))[None, None, :]
        salts = common.mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))[None, :]
        for table in common.gathered(batches):
            codes, bounds = shingle_sets(common.one(table, "text"), shingle)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            kinds = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
            keys: list = [None] * len(n)
            sigs: list = [None] * len(n)
            if len(full):
                packed = np.concatenate([bounds[full], bounds[-1:]])
                for kind, salt in zip(kinds, (0x1234567, 0x89ABCDEF), strict=True):
                    kind[full] = np.add.reduceat(common.mix64(codes ^ np.uint64(salt)), packed[:-1]).view(np.int64)
                sig = signatures(codes, packed, bands * rows)
                mixed = common.mix64((sig.reshape(len(full), bands, rows).astype(np.uint64) * weights).sum(2, dtype=np.uint64) ^ salts).view(np.int64)
                low = sig.astype(np.uint8)
                for k, r in enumerate(full.tolist()):
                    keys[r], sigs[r] = mixed[k], low[k].tobytes()
            yield pa.RecordBatch.from_arrays([common.one(table, "doc_id"), pa.array(n, pa.int64()), pa.array(kinds[0]), pa.array(kinds[1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "keys", "sig"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.gathered(batches):
            codes, bounds = shingle_sets(common.one(table, "text"), shingle)
            yield pa.RecordBatch.from_arrays([common.one(table, "rep"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes.view(np.int64)))], names=["rep", "codes"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches; label propagation with pointer jumps on settled tables."""
    spark = edges.sparkSession
    both = common.settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = common.join_checked(both, labels.select(F.col("node").alias("b"), "label"), ["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = common.settle(common.join_checked(new, jump, ["next"]).select("node", F.least("next", "far").alias("label"), "old"), "labels")
        changed = moved.where("label <> old").limit(1).count()
        common.remove(spark, labels.settled_at)
        labels = moved.select("node", "label")
        labels.settled_at = moved.settled_at
        if not changed:
            return labels


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, settled."""
    pairs = common.settle(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = common.settle(texts.join(common.settle(wanted, "wanted"), "rep", "left_semi").mapInArrow(common.tidy(_sets(shingle)), "rep long, codes array<long>").dropDuplicates(["rep"]), "sets")
    left = common.join_checked(pairs, sets.select(F.col("rep").alias("a"), F.col("codes").alias("codes_a")), ["a"], most=0)
    full = common.join_checked(left, sets.select(F.col("rep").alias("b"), F.col("codes").alias("codes_b")), ["b"], most=0)
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    good = common.settle(full.where(100 * both >= percent * (F.size("codes_a") + F.size("codes_b") - both)).select("a", "b"), "links")
    common.remove(pairs.sparkSession, sets.settled_at)
    return good


def _by_block(work):
    """A mapInArrow function that hands ``work`` tables of whole blocks: rows come in order of (key, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> pa.Table:
            nonlocal held
            t = pa.Table.from_batches(held).combine_chunks()
            held = []
            if not last:
                k, c = t.column("key").to_numpy(), t.column("cell").to_numpy()
                other = np.flatnonzero((k != k[-1]) | (c != c[-1]))
                tail = int(other[-1]) + 1 if len(other) else 0
                held = t.slice(tail).to_batches()
                t = t.slice(0, tail)
            return t

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 4096:
                    t = whole(False)
                    if t.num_rows:
                        yield from work(t)
        if held:
            yield from work(whole(True))

    return run


def _bounds(t: pa.Table) -> list[tuple[int, int]]:
    key, cell = t.column("key").to_numpy(), t.column("cell").to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])).tolist()
    return list(zip(edge, [*edge[1:], len(key)], strict=True))


def _near(t: pa.Table, s: int, e: int, sig: np.ndarray, least: int):
    """(probe, member, agreement) places of a block's pairs of different components that come near the threshold."""
    label, probe, member = (t.column(c).to_numpy()[s:e] for c in ("label", "probe", "member"))
    p, m = np.flatnonzero(probe), np.flatnonzero(member)
    for k in range(0, len(p), 32):
        some = p[k : k + 32]
        agree = (sig[s + some][:, None, :] == sig[s + m][None, :, :]).sum(2, dtype=np.int16)
        x, y = np.nonzero((label[some][:, None] != label[m][None, :]) & (agree >= least))
        yield s + some[x], s + m[y], agree[x, y]


def _screen(size: int, least: int):
    """The rows of blocks that have a near partner of another component there."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, size)
        good = np.zeros(t.num_rows, bool)
        for s, e in _bounds(t):
            for x, y, _ in _near(t, s, e, sig, least):
                good[x] = good[y] = True
        yield from t.filter(pa.array(good)).to_batches()

    return _by_block(work)


def _link(size: int, least: int, percent: int):
    """Links (a, b) between the components of a block, verified on full sets; a component that is linked already is asked no more."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, size)
        rep, label = t.column("rep").to_numpy(), t.column("label").to_numpy()
        codes, sets = t.column("codes").combine_chunks(), {}
        out = []
        for s, e in _bounds(t):
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            sets.clear()
            for x, y, agree in _near(t, s, e, sig, least):
                for k in np.argsort(-agree, kind="stable").tolist():
                    i, j = int(x[k]), int(y[k])
                    one, two = find(int(label[i])), find(int(label[j]))
                    if one == two:
                        continue
                    for w in (i, j):
                        if w not in sets:
                            sets[w] = frozenset(codes[w].as_py())
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        up[max(one, two)] = min(one, two)
                        out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_block(work)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    size = bands * rows
    spread = math.sqrt(percent / 100 * (1 - percent / 100) / size)
    least = math.floor(size * (percent / 100 - 5 * spread))
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = common.settle(slim.mapInArrow(common.tidy(_signed(bands, rows, shingle)), "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>, sig binary"), "signed")
    # 1. classes of equal sets
    classes = common.settle(signed.where("n_shingles > 0").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("rep is not null"), "classes")
    # one row of a class goes on: that of its smallest id; ids and classes are unique here, so nothing is skewed
    reps = signed.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), "c1", "c2"), ["doc_id", "c1", "c2"], "left_semi").select(F.col("doc_id").alias("rep"), "keys", "sig")
    reps = common.settle(reps, "reps")
    # 2. buckets of two or more
    entries = reps.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("p")).where("n > 1").select("key", "n", F.col("p.rep").alias("pivot"))
    members = common.settle(common.join_checked(entries, common.settle(buckets, "buckets"), ["key"]), "members")
    sigs = reps.select("rep", "sig")
    # 3. stars
    stars = members.where("rep <> pivot").select("rep", "pivot").distinct()
    stars = stars.join(sigs, "rep").withColumnRenamed("sig", "sig_rep").join(sigs.withColumnsRenamed({"rep": "pivot", "sig": "sig_pivot"}), "pivot").mapInArrow(common.tidy(_agreement(size)), "rep long, pivot long, agree int")
    stars = stars.where(F.col("agree") >= least)
    best = stars.groupBy("rep").agg(F.max(F.struct("agree", "pivot")).alias("s1"), F.max(F.when(F.pmod(F.xxhash64("pivot"), F.lit(2)) == 0, F.struct("agree", "pivot"))).alias("s2"), F.max(F.when(F.pmod(F.xxhash64("pivot"), F.lit(2)) == 1, F.struct("agree", "pivot"))).alias("s3"))
    chosen = best.select("rep", F.explode(F.array_distinct(F.array_compact(F.array("s1.pivot", "s2.pivot", "s3.pivot")))).alias("pivot")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    texts = slim.withColumnRenamed("doc_id", "rep")
    texts = texts.where("rep is not null")
    links = _verified(chosen, texts, shingle, percent)
    labels = components(links)
    # 4. buckets that span several components
    named = common.join_checked(members.select("key", "n", "rep"), labels.withColumnRenamed("node", "rep"), ["rep"], "left").withColumn("label", F.coalesce("label", "rep"))
    named = common.settle(named, "named")
    parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).where(F.col("top.m") < F.col("all")).select("key", F.col("top.label").alias("top"), (F.col("all") - F.col("top.m")).alias("others"))
    open_ = common.join_checked(named, common.settle(parts, "open"), ["key"])
    cells_m, cells_p = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("others") / BLOCK)
    is_probe = F.col("label") != F.col("top")
    # a member's block takes part in every block of probes, and a probe's in every block of members
    mine_m, mine_p = F.pmod(F.xxhash64("rep"), cells_m), F.pmod(F.xxhash64("rep", F.lit(1)), cells_p)
    as_member = open_.select("key", "rep", "label", F.lit(False).alias("probe"), F.lit(True).alias("member"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), cells_p - 1), lambda p: p * cells_m + mine_m)).alias("cell"))
    as_probe = open_.where(is_probe).select("key", "rep", "label", F.lit(True).alias("probe"), F.lit(False).alias("member"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), cells_m - 1), lambda m: mine_p * cells_m + m)).alias("cell"))
    placed = as_member.union(as_probe).join(sigs, "rep").select("key", "cell", "rep", "label", "probe", "member", "sig")
    near = placed.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(common.tidy(_screen(size, least)), placed.schema)
    near = common.settle(near, "near")
    sets = common.settle(texts.join(common.settle(near.select("rep").distinct(), "wanted"), "rep", "left_semi").mapInArrow(common.tidy(_sets(shingle)), "rep long, codes array<long>").dropDuplicates(["rep"]), "sets")
    full = common.join_checked(near, sets, ["rep"], most=0).select(*near.columns, "codes").repartition("key", "cell").sortWithinPartitions("key", "cell")
    more = common.settle(full.mapInArrow(common.tidy(_link(size, least, percent)), "a long, b long"), "more")
    labels = components(links.union(more))
    # back to documents: only classes of several copies or with links say more than the document itself
    told = common.join_checked(classes, labels.withColumnRenamed("node", "rep"), ["rep"], "left").where("copies > 1 or label is not null").select("c1", "c2", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    told = common.settle(told, "told")
    out = common.join_checked(signed.select("doc_id", "n_shingles", "c1", "c2"), told, ["c1", "c2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _agreement(size: int):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, size) for c in ("sig_rep", "sig_pivot"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("rep")), batch.column(batch.schema.get_field_index("pivot")), pa.array((a == b).sum(1), pa.int32())], names=["rep", "pivot", "agree"])

    return run


def op9_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
