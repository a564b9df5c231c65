"""The ten operators against brute force on the smallest tables and on a frame of edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import common, op01_warc, op02_quality, op03_word_bpe, op04_sharding, op05_decontamination, op06_wavelet, op07_language, op08_pii, op09_neardup, op10_cnn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(20000))
TEXTS = ["", None, "Hello  wörld <|endoftext|>x \n\n\n a.b@c.de +49 (171) 555-1234\t", "the the the the", "x", "    b  ", LONG, LONG, "日本語 テキスト 123 4111 1111 1111 1111 10.0.0.1", "été über straße ÉTÉ   <b>&", "1.2.3.4.5.6.7.8 300.1.1.1 " + "9" * 40]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    rows = [(i if i != 4 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", i, "a", True, 5) for i, t in enumerate(TEXTS)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, key string, kept boolean, shard int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return Counter(map(repr, rows))


# ---------------------------------------------------------------- 1


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a", "<p>small"), (2, None, None), (3, "http://b\r\n%", big), (5, "u", big), (4, "u", big), (4, "u", big), (6, "u", "é" * 60), (None, "u", "<p>small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    op01_warc.write_warc(pages, str(tmp_path / "w"))
    got = op01_warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert {r["kind"] for r in got} == {"record"}
    want = [(i, u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, u, h in rows]
    assert counted((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == counted(want)
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 3} == {big.encode()}


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    made = [op01_warc.record(i, "u", b"p" * (50 + i), hashlib.sha256(b"p" * (50 + i)).hexdigest(), 50 + i, None, "response") for i in range(6)]
    parts = [op01_warc.member(m) if packed else m for m in made]
    broken = bytearray(b"".join(parts))
    ends = np.cumsum([0, *map(len, parts)])
    broken[ends[2] - 20] ^= 0xFF  # record 1
    data = bytes(broken[: ends[3]]) + b"junk" * 30 + bytes(broken[ends[3] : ends[5]]) + parts[5][:-30]
    got = list(op01_warc.salvage(data))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3, 4]
    gaps = [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"]
    assert gaps == [(ends[1], len(parts[1])), (ends[3], 120), (ends[5] + 120, len(parts[5]) - 30)] and all(r["reason"] for r in got if r["kind"] == "gap")


def test_warc_members_of_many():
    """A member of many records loses only the damaged ones: a bad digest, a cut, a bad checksum."""
    rng = random.Random(6)
    pages = [bytes(rng.randrange(256) for _ in range(3000)) for _ in range(9)]
    made = [op01_warc.record(i, "u", p, hashlib.sha256(p).hexdigest(), len(p), None, "response") for i, p in enumerate(pages)]
    bad = made[4].replace(pages[4], pages[4][::-1])
    ids = lambda data: [r["page_id"] for r in op01_warc.salvage(data) if r["kind"] == "record"]
    gaps = lambda data: [(r["offset"], r["length"], r["reason"]) for r in op01_warc.salvage(data) if r["kind"] == "gap"]
    last = op01_warc.member(made[8])
    whole = op01_warc.member(b"".join([*made[:4], bad, *made[5:8]]))
    assert ids(whole + last) == [0, 1, 2, 3, 5, 6, 7, 8] and gaps(whole + last) == [(0, len(whole), "payload digest")]
    for level in (0, 4):
        whole = op01_warc.member(b"".join(made[:8]), level)
        cut = whole[: len(whole) // 2]
        assert ids(cut) == [0, 1, 2, 3][: len(ids(cut))] and len(ids(cut)) >= 3 and gaps(cut) == [(0, len(cut), "member cut short")]
        sums = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
        assert ids(sums + last) == list(range(9)) and [g[2] for g in gaps(sums + last)][0] == "member"


def test_warc_linear():
    """Twice the members take about twice the time."""
    import time

    one = op01_warc.member(op01_warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None, "response"))

    def seconds(n):
        began = time.process_time()
        assert sum(1 for _ in op01_warc.salvage(one * n)) == n
        return time.process_time() - began

    seconds(500)
    assert min(seconds(8000) for _ in range(2)) < 3 * max(0.05, min(seconds(4000) for _ in range(2)))


def test_warc_of_others():
    """Records of other writers: no private header, sha1 digests, all types."""
    import base64

    def made(kind, block, *more):
        return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, *more, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha1 = lambda b: b"sha1:" + base64.b32encode(hashlib.sha1(b).digest())
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    kind = b"Content-Type: application/http; msgtype=response"
    rows = [made(b"warcinfo", b"software: x"), made(b"request", b"GET / HTTP/1.1\r\n\r\n", kind), made(b"response", http + b"body", kind, b"WARC-Target-URI: http://a/%25", b"WARC-Payload-Digest: " + sha1(b"body"), b"WARC-Block-Digest: " + sha1(http + b"body")), made(b"metadata", b"m: 1"), made(b"revisit", http, kind, b"WARC-Payload-Digest: " + sha1(b"body"))]
    wrong = made(b"response", http + b"bodx", kind, b"WARC-Payload-Digest: " + sha1(b"body"))
    for pack in (op01_warc.member, bytes):
        got = list(op01_warc.salvage(b"".join(map(pack, [*rows, wrong]))))
        assert [(r["record_type"], r["payload_bytes"]) for r in got if r["kind"] == "record"] == [("warcinfo", 11), ("request", 0), ("response", 4), ("metadata", 4), ("revisit", None)]
        assert got[2]["payload"] == b"body" and got[2]["url"] == "http://a/%25" and got[2]["payload_digest"] == sha1(b"body").decode()
        assert [r["reason"] for r in got if r["kind"] == "gap"] == ["payload digest"]


# ---------------------------------------------------------------- 2


def stats(text):
    w = WORD.findall(text)
    seen, dup, grams = set(), 0, Counter(zip(w, w[1:], w[2:]))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_quality_stats(request, which):
    df = request.getfixturevalue(which)
    got = op02_quality.quality_rules(df).collect()
    want = [(i, *stats(t)) for i, t in texts_of(df)]
    assert counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == counted(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_outliers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(80, 300))) for _ in range(400)]
    junk = [" ".join(word() + rng.choice("#$%&") * 3 for _ in range(120)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in op02_quality.quality_rules(df).collect()}
    assert sum(kept[i] for i in range(400)) == 400 and not any(kept[i] for i in range(400, 420))


def test_quality_tables(spark):
    """Table junk (a bar behind every word or two) is rejected; clean texts with a few chance repeats stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(80, 300))) for _ in range(400)]
    for i in range(0, 400, 10):
        clean[i] += " " + " ".join(clean[i].split()[:4])
    junk = [" ".join(word() + rng.choice(["", " |"]) for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in op02_quality.quality_rules(df).collect()}
    assert sum(kept[i] for i in range(400)) >= 396 and not any(kept[i] for i in range(400, 420))


def test_chi2():
    assert abs(op02_quality.chi2_quantile(0.999, 5) - 20.515) < 1e-3


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_word_bpe(request, which):
    df = request.getfixturevalue(which)
    path = op03_word_bpe.vocabulary()
    t = op03_word_bpe.tokenizer(path)
    encoded = op03_word_bpe.encode(df, chunk_bytes=50_000)
    got = op03_word_bpe.decode(encoded.withColumn("copy", F.col("ids"))).collect()
    want = []
    for i, x in texts_of(df):
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    assert counted((r["doc_id"], r["copy"], r["text"]) for r in got) == counted(want)


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_shards(request, which):
    df = request.getfixturevalue(which)
    got = op04_sharding.assign_shards(df, 7, carry=["lang"]).collect()
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == counted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts_of(df))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_matrix():
    m = np.array(op04_sharding.draw_matrix([100, 0, 37, 5000], 9, 3))
    assert m.sum(1).tolist() == [100, 0, 37, 5000] and m.sum(0).max() - m.sum(0).min() <= 1
    mean = np.mean([op04_sharding.draw_matrix([10, 30], 4, s)[0] for s in range(2000)], 0)
    assert np.allclose(mean, 2.5, atol=0.15)


def test_large_draws():
    """The draws beyond numpy's limit follow the same law: against it where both can draw, and by moments where only one can."""
    rng = np.random.default_rng(5)
    for good, bad, need in ((5000, 7000, 900), (30, 10, 25), (10**6, 10**5, 10**4)):
        mine = np.array([op04_sharding._large(rng, good, bad, need) for _ in range(4000)])
        theirs = rng.hypergeometric(good, bad, need, 40000)
        assert abs(mine.mean() - theirs.mean()) < 5 * theirs.std() / 4000**0.5 and abs(mine.std() / theirs.std() - 1) < 0.06
        for q in (0.1, 0.5, 0.9):
            cut = np.quantile(theirs, q)
            assert abs((mine <= cut).mean() - (theirs <= cut).mean()) < 0.04
    good, bad, need = 3 * 10**12, 7 * 10**12, 10**12
    mine = np.array([op04_sharding._large(rng, good, bad, need) for _ in range(2000)], float)
    spread = (need * 0.3 * 0.7 * 0.9) ** 0.5
    assert abs(mine.mean() - need * 0.3) < 5 * spread / 2000**0.5 and abs(mine.std() / spread - 1) < 0.08
    m = np.array(op04_sharding.draw_matrix([10**10, 3 * 10**9 + 7, 5], 40, 3))
    assert m.sum(1).tolist() == [10**10, 3 * 10**9 + 7, 5] and m.sum(0).max() - m.sum(0).min() <= 1


# ---------------------------------------------------------------- 5


def test_edit_search():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        row, best = [0] * (len(b) + 1), None
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(row)
        assert op05_decontamination.distance_within(a, b, 99) == best


def test_leaks(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join((t or "").translate(LOWER).split())
    known = {r["item_id"]: plain(r["text"]) for r in items.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op05_decontamination.contaminated(docs, items).collect()}
    exact = {(i, k) for i, t in texts_of(docs) for k, v in known.items() if v in plain(t)}
    assert exact and exact <= got
    rng, rows, want = random.Random(3), [], 0
    for n, (k, v) in enumerate(known.items()):
        s = list(v)
        for _ in range(int(0.05 * len(s))):
            s[rng.randrange(len(s))] = rng.choice("abcdef")
        rows.append((n, "Before it stands this. " + "".join(s) + " And this behind it."))
    found = {r["doc_id"] for r in op05_decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items, block_bytes=2000).collect()}
    assert len(found) >= 0.95 * len(rows)
    left = op05_decontamination.clean(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in texts_of(docs)} - {i for i, _ in got}


def test_leaks_edge(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op05_decontamination.contaminated(edge, none).count() == 0 and op05_decontamination.clean(edge, none).count() == edge.count()
    items = spark.createDataFrame([(1, LONG[:300]), (2, None), (3, "x"), (1, LONG[:300])], "item_id long, text string")
    assert {r["doc_id"] for r in op05_decontamination.contaminated(edge, items).collect()} == {6, 7}


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_leaks_edited(sf, share):
    """Every item with mixed edits up to the limit is found, as brute force finds it; in scripts without spaces too."""
    import pyarrow.parquet as pq

    rng = random.Random(11)
    known = [" ".join(t.translate(LOWER).split()) for t in pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()]
    known += ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 400)) for _ in range(n)) for n in (24, 25, 40, 61, 120)]
    rows = []
    for t in known:
        s = list(t)
        for i in rng.sample(range(len(s)), int(share * len(s))):
            s[i] = rng.choice(["", rng.choice("etaoin"), s[i] + rng.choice("etaoin")])
        rows.append(("文" * 9 if t > "z" else "Before it stands this. ") + "".join(s) + ("字" * 9 if t > "z" else " And this behind it."))
    got = op05_decontamination.Index(list(enumerate(known)), 0.8).search(pa.array([*rows, None, ""]))
    for n, t in enumerate(rows):
        plain = " ".join(t.translate(LOWER).split())
        want = {k for k, v in enumerate(known) if op05_decontamination.distance_within(v, plain, int(0.2 * len(v) + 1e-9)) is not None}
        assert n in want and {k for k, _ in got[n]} == want


def brute_leaks(known, text):
    """The least distance of each item that a text holds within the limit."""
    plain = " ".join((text or "").translate(LOWER).split())
    found = {k: op05_decontamination.distance_within(v, plain, int(0.2 * len(v) + 1e-9)) for k, v in enumerate(known)}
    return [(k, d) for k, d in found.items() if d is not None]


def test_leaks_least(sf, monkeypatch):
    """Hyphens for spaces, several occurrences at different distances, and a text of several slices: distances are the least, as brute force has them."""
    import pyarrow.parquet as pq

    rng = random.Random(12)
    known = [" ".join(t.translate(LOWER).split()) for t in pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()][:8]
    rows = [t.replace(" ", "-") for t in known]
    for t in known:
        s = list(t)
        for i in rng.sample(range(len(s)), len(s) // 8):
            s[i] = "q"
        rows.append("One. " + "".join(s) + " Two. " + t + " Three. " + "".join(s))
    rows.append(" ".join(f"w{rng.randrange(500)}" for _ in range(4000)) + " ".join(rows) + " ".join(f"é{rng.randrange(500)}" for _ in range(4000)))
    index = op05_decontamination.Index(list(enumerate(known)), 0.8)
    want = [brute_leaks(known, t) for t in rows]
    assert index.search(pa.array(rows)) == want and all((n, 0) in want[8 + n] for n in range(8))
    monkeypatch.setattr(op05_decontamination, "SLICE", 9000)
    assert index.search(pa.array(rows)) == want


@pytest.mark.parametrize("share, least", [(0.05, 1.0), (0.1, 1.0), (0.15, 0.99), (0.2, 0.95)])
def test_leaks_keys(sf, share, least):
    """The sampled keys alone find this share of edited items."""
    import pyarrow.parquet as pq

    rng = random.Random(13)
    known = [" ".join(t.translate(LOWER).split()) for t in pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()]
    index = op05_decontamination.Index(list(enumerate(known)), 0.8)
    index.groups[1].close = lambda classes, at, group: np.zeros(len(at), bool)
    rows, want = [], 0
    for t in known * 5:
        s = list(t)
        for i in rng.sample(range(len(s)), int(share * len(s))):
            s[i] = rng.choice(["", rng.choice("etaoin"), s[i] + rng.choice("etaoin")])
        rows.append("".join(s))
    got = index.search(pa.array(rows))
    assert sum(n % len(known) in dict(r) for n, r in enumerate(got)) >= least * len(rows)


def test_leaks_short(spark):
    """Items below 24 code points are found where they stand whole."""
    items = spark.createDataFrame([(1, "Who is it?"), (2, "東京は首都か"), (3, "ab cd"), (4, "Ünder")], "item_id long, text string")
    texts = ["So: who  is\nit? asked one.", "答えは東京は首都かという", "ab cd", "xab cd", "ab cde", "(AB CD)", "Ünder", "wÜnder", "who is it", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in op05_decontamination.contaminated(docs, items).collect()}
    assert got == {(0, 1, 0), (1, 2, 0), (2, 3, 0), (5, 3, 0), (6, 4, 0)}


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_files(request, spark, tmp_path, monkeypatch, which):
    df = request.getfixturevalue(which)
    t = op06_wavelet.tokenizer(op06_wavelet.vocabulary())
    op06_wavelet.write_tokens(df, str(tmp_path / "t"), shard_bytes=100_000)
    rows = op06_wavelet.with_starts(op06_wavelet.read_tokens(spark, str(tmp_path / "t"))).orderBy("start").collect()
    want = [(i, t.encode(x, add_special_tokens=False).ids + [2]) for i, x in texts_of(df)]
    assert counted((r["doc_id"], list(r["ids"])) for r in rows) == counted(want)
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert sum(r["n"] for r in op06_wavelet.look_up(spark, str(tmp_path / "t"), 2).collect()) == sum(ids.count(2) for _, ids in want)


def test_wavelet():
    rng = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 1), (1000, 3), (5000, 50257)):
        a = rng.integers(0, top, n)
        w = op06_wavelet.Wavelet.build(a, max(1, int(top - 1).bit_length()))
        assert (w.all() == a).all()
        for k in rng.integers(0, n, 20).tolist() if n else []:
            v = int(a[k])
            places = np.flatnonzero(a == v)
            assert w.access(k) == v and w.count(v) == len(places) and w.count(v, 0, k) == (a[:k] == v).sum()
            j = int(rng.integers(0, len(places)))
            assert w.select(v, j) == places[j] and w.select(v, len(places)) == -1


def test_byte_pieces():
    rng, path = random.Random(5), op06_wavelet.vocabulary()
    t = op06_wavelet.tokenizer(path)
    alphabet = list("ab 's\n\t\r.,0<|>é  　日😀ñ'll") + ["  ", "<|endoftext|>", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encoder = op06_wavelet.Encoder(path)
    encoder.rows(pa.array(texts[:1000]), None)
    ids, rows = encoder.rows(pa.array(texts), None)
    for k, x in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


# ---------------------------------------------------------------- 7


def plain_ppm(texts, sample):
    """Code length in bits of a text by counts of contexts of up to three bytes, walked one byte at a time."""
    counts = defaultdict(Counter)
    symbols = set()
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for k in range(3, len(b)):
            symbols.add(b[k])
            for n in range(4):
                counts[b[k - n : k]][b[k]] += 1
    return counts, symbols


def test_ppm_lengths(monkeypatch):
    texts = ["the cat sat on the mat", "a cat and a hat"]
    counts, symbols = plain_ppm(texts, None)
    grams = Counter()
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for k in range(3, len(b)):
            grams[b[k] | b[k - 1] << 8 | b[k - 2] << 16 | b[k - 3] << 24] += 1
    keys = np.array(sorted(grams))
    model = op07_language.Model({"langs": ["x"], "grams": keys, "counts": np.array([[grams[k]] for k in keys.tolist()])})
    monkeypatch.setattr(op07_language, "SLICE", 5)
    both = model.lengths(*common.flat_text(pa.array(["", "the hat", None, "zebra the", "ö"])))
    for text in ("the hat", "cat and mat on", "zebra the"):
        b, total = b"\0\0\0" + text.encode(), 0.0
        for k in range(3, len(b)):
            p = 1 / 256
            for n in range(4):
                c = counts.get(b[k - n : k])
                if c:
                    size, kinds = sum(c.values()), len(c)
                    p = c[b[k]] / (size + kinds) if c.get(b[k]) else kinds / (size + kinds) * p
            total -= np.log2(p)
        got = model.lengths(*common.flat_text(pa.array([text])))[0, 0]
        assert abs(got - total) < 1e-3, text
        assert text == "cat and mat on" or abs(both[1 if text == "the hat" else 3, 0] - total) < 1e-3
    assert both[0, 0] == both[2, 0] == 0 and both[4, 0] > 0


def test_language(spark, docs, edge):
    got = op07_language.predict(docs, op07_language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").withColumn("fold", common.doc_fold()).collect()
    held = [r for r in got if r["fold"] == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.9 and all(0 <= r["score"] <= 1 for r in got)
    rows = op07_language.predict(edge, op07_language.train(docs)).collect()
    assert len(rows) == edge.count() and [r["lang_pred"] for r in rows[:2]] == ["und", "und"]
    assert {r["lang_pred"] for r in op07_language.predict(edge, None).collect()} == {"und"}


# ---------------------------------------------------------------- 8

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (12 <= len(d) <= 19 and op08_pii.luhn(d)) or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_random():
    rng = random.Random(7)
    pieces = ["a", "b.c", "@", ".", "-", "1", "22", "255", "256", "+4", " ", "(", ")", "4111111111111111", "x@y.z", "%", "1.2.3.4"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert op08_pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_pii(request, which):
    df = request.getfixturevalue(which)
    found = op08_pii.find(df)
    got = op08_pii.judge(found, op08_pii.train(found)).collect()
    text = {}
    want = []
    for i, t in texts_of(df):
        s = plain_spans(t)
        text[i] = t
        want.append((i, *[sum(x[1] == k for x in s) for k in range(4)], hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()))
    assert counted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == counted(want)
    for r in got:
        assert {f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in plain_spans(text[r["doc_id"]])} <= set(r["spans"].split(","))
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x])


def test_redact(spark):
    rows = [(1, 'call +49 171 5551234 or a.b@c.de, token = "f3ef4d6b2755a36d7d9c25bd72c4d5f6"', 0, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, more string")
    got = op08_pii.redact(df, op08_pii.train(op08_pii.find(df))).collect()
    assert all(r["text"].startswith("call [PHONE] or [EMAIL], token = ") and r["n_chars"] == len(r["text"]) and r["more"] == "x" for r in got)


@pytest.mark.parametrize("address", ["john(AT)example.com", "john[At]example.com", "john AT example DOT com", "john at example.com", "john[AT]example.com", "john [at] example [dot] com"])
def test_spelled(address):
    for before in ("", "Grüße von ", "meet at noon. "):
        text = f"{before}{address}, thanks"
        assert (len(before), 0, len(before) + len(address)) in op08_pii.candidates(text, op08_pii.base_spans(text))
    text = "ring at 030. 555 1234 5678, no address"
    assert 3 in {k for _, k, _ in op08_pii.candidates(text, [])}


def test_long_secret(spark):
    secret = "eyJ" + "".join(random.Random(4).choice("abcXYZ0189._-") for _ in range(900))
    text = f'token = "{secret}" end'
    assert op08_pii.candidates(text, []) == [(9, 4, 9 + len(secret))]
    df = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    assert op08_pii.redact(df, {(4, op08_pii.votes(text, 9, 4, 9 + len(secret), False)): True}).first()["text"] == 'token = "[SECRET]" end'


def test_reliabilities():
    table, p = op08_pii.reliabilities([(0, "+++0000", 90), (0, "--00000", 10), (0, "++00000", 20)])
    assert table.shape == (2, op08_pii.LABELERS, 3) and np.allclose(table.sum(2), 1) and p[0] > 0.9 and p[1] < 0.1


# ---------------------------------------------------------------- 9


def plain_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, docs, shingle):
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(70)]
    rows = texts_of(docs)
    for k in range(60):  # a chain and a cloud of near copies
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op09_neardup.near_duplicates(df, shingle=shingle).collect()}
    assert got == plain_components(rows, shingle, 80)


def test_near_duplicates_edge(edge):
    got = op09_neardup.near_duplicates(edge, shingle=2).collect()
    assert len(got) == edge.count() and all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[7] == 6 and by[0] == 0 and by[1] == 1 and by[None] is None


def test_circulant():
    """Shifted by one, the second permutation gives the next coordinate; estimates are unbiased."""
    rng = np.random.default_rng(1)
    a = common.mix64(rng.integers(0, 2**62, 400).astype(np.uint64))
    both = np.concatenate([a[:300], a[100:]])
    sig = op09_neardup.signatures(both, np.array([0, 300, 600]), 240)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12
    assert len(np.unique(op09_neardup.sigma(np.arange(100000, dtype=np.uint32)))) == 100000


# ---------------------------------------------------------------- 10


def test_cnn_gradients():
    net = op10_cnn.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = pa.array(["abc abc abc abc abc", "Hello there! " * 60, "", "zz"])
    x, y = op10_cnn.Layout(*common.flat_text(texts)), np.array([0.0, 1.0, 1.0, 0.0])
    loss = lambda: -np.mean(y * np.log(net.score(x)) + (1 - y) * np.log(1 - net.score(x)))
    g, rng = net.gradients(x, y), np.random.default_rng(0)
    for k, p in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            keep, step = p[at], 1e-5
            p[at] = keep + step
            up = loss()
            p[at] = keep - step
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3, k


def test_cnn_slices(monkeypatch):
    """A text in slices has the score of the text laid out at once."""
    monkeypatch.setattr(op10_cnn, "SLICE", 1024)
    net, rng = op10_cnn.Net(3), random.Random(8)
    for n in (1025, 1300, 2048, 5000, 9999):
        text = pa.array(["".join(rng.choice("ab cd$ ef") * rng.randint(1, 3) for _ in range(n))[:n]])
        data, offsets = common.flat_text(text)
        assert abs(net.score_long(data)[0] - net.score(op10_cnn.Layout(data, offsets))[0]) < 1e-5


def test_cnn_plain():
    """Scores against a convolution written out position by position."""
    net = op10_cnn.Net(4)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for text in ("", "abc", "abcdabcdabcd $$ abcdabcd " * 20, "é" * 300):
        raw = text.encode()
        n, halves = max(1, -(-len(raw) // 4)), max(1, -(-len(raw) // 256))
        at = lambda k: [raw[k + j] if k + j < len(raw) else 0 for j in range(4)]
        cell = [at(4 * k) for k in range(n)] + [[0] * 4]
        again = [k * 4 >= 16 and any(cell[k]) and any([raw[4 * k - d + j] if 4 * k - d + j < len(raw) else 0 for j in range(4)] == cell[k] for d in op10_cnn.LAGS) for k in range(n)] + [False]
        e = [np.concatenate([p["E"][b] for b in c]) for c in cell]
        out = np.array([e[k] @ p["A"] + e[k + 1] @ p["B"] + again[k] * p["R"][0] + again[k + 1] * p["R"][1] + p["c"] for k in range(n)])
        tops = [out[h * 64 : h * 64 + 64].max(0) for h in range(halves)]
        chunks = np.maximum([np.maximum(tops[k], tops[k + 1]) for k in range(halves - 1)] or [tops[0]], 0)
        hidden = np.tanh(np.concatenate([chunks.mean(0), chunks.max(0)]) @ p["H"] + p["h"])
        want = 1 / (1 + np.exp(-(hidden @ p["o"] + p["z"][0])))
        assert abs(net.score(op10_cnn.Layout(*common.flat_text(pa.array([text]))))[0] - want) < 1e-4, text[:20]


def test_cnn(spark, edge):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() + ("$$$" if i % 2 else "") for _ in range(60))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = op10_cnn.predict(df, op10_cnn.train(df, labels)).withColumn("fold", common.doc_fold()).collect()
    held = [r for r in got if r["fold"] == 2]
    assert held and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in held]) >= 0.95
    one = op10_cnn.predict(edge, op10_cnn.train(df, labels.where("quality = 1"))).collect()
    assert len(one) == edge.count() and {r["score"] for r in one} == {1.0}


# ---------------------------------------------------------------- empty tables


def test_empty(spark, docs, tmp_path):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op02_quality.quality_rules(none).count() == 0
    assert op03_word_bpe.encode(none).count() == 0
    assert op04_sharding.assign_shards(none).count() == 0
    op06_wavelet.write_tokens(none, str(tmp_path / "t"))
    assert op06_wavelet.read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert op07_language.predict(none, op07_language.train(none)).count() == 0
    found = op08_pii.find(none)
    assert op08_pii.judge(found, op08_pii.train(found)).count() == 0
    assert op09_neardup.near_duplicates(none).count() == 0
    assert op10_cnn.predict(none, op10_cnn.train(none, labels)).count() == 0
    op01_warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert op01_warc.read_warc(spark, str(tmp_path / "w")).count() == 0
