"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates are spans of
looser shapes: spelled-out addresses, phone numbers without a plus, secrets behind a cue, social security
numbers. Every candidate - base spans too, as anchors - gets votes for, against or none of seven labelers:

- regex: strict shape, loose shape;
- gazetteer: known top-level domains, dialling formats and secret prefixes;
- context: a cue word of the kind before it; signs of a plain number or code around it; uniform or
  sequential characters; high variety of characters.

A two-class expectation-maximisation over the counts of all vote patterns of the corpus estimates each
labeler's reliabilities and each candidate's probability; these soft labels train the final classifier, a
logistic regression over kind, votes and length. Patterns are few by construction (kinds x 3^7 x
length classes), so only their counts come to the driver, over all documents.

Edge cases: null and empty texts have no spans; repeated rows give equal rows; extra columns are ignored
(``redact`` keeps them); an empty table gives an empty result; patterns are linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: Characters of an address's local part, a fixed value.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and anchored at a run's start, these find what the contract's patterns find, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-]*[0-9])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
SPELLED = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\bat\b)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\bdot\b|\.) ?[A-Za-z0-9-]++)++", re.I)
SECRET = re.compile(r"(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=.~-]{8,}+)", re.I)
#: The gazetteers, fixed values.
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl be".split())
SECRET_STARTS = ("AKIA", "ghp_", "sk-", "xox", "eyJ", "AIza")
CUES = {"email": r"mail|contact|write|@", "ip": r"\bip\b|host|server|address|login", "card": r"card|visa|credit|payment|iban", "phone": r"phone|tel|call|mobile|fax|contact|whatsapp", "secret": r"token|password|passwd|secret|key", "ssn": r"ssn|social|security"}
CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
PLAIN = re.compile(r"(?:page|vol|no|isbn|version|v|fig|chapter|\$|€|#)\.?\s?$", re.I)
LABELERS = 7
#: The weight of all candidates together against the ridge's, which is 1.
WEIGHT = 1e4


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the address pattern, found from each @ in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        run = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if run else None
        if m:
            out.append((at - run, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out addresses; a plain "at" before one must not take its local part, so the search goes on behind the separator."""
    m = SPELLED.search(text)
    while m:
        yield m.span()
        m = SPELLED.search(text, m.end(1))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans of loose shapes that meet no base span; only spelled-out addresses may meet others, as most are plain words."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(1), 4, m.end(1)) for m in SECRET.finditer(text)]
    if "-" in text:
        found += [(m.start(), 5, m.end()) for m in SSN.finditer(text)]
    if re.search(r"[0-9][ .)-]", text):
        found += [(m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 12]
    out, taken = [], sorted((a, b) for a, _, b in base)
    ends = [b for _, b in taken]
    from bisect import bisect_right

    last = -1
    for a, k, b in sorted(found):
        at = bisect_right(ends, a)
        if a >= last and not (at < len(taken) and taken[at][0] < b):
            out.append((a, k, b))
            last = b
    for a, b in spelled(text):
        at = bisect_right(ends, a)
        if not (at < len(taken) and taken[at][0] < b):
            out.append((a, 0, b))
    return sorted(out)


def votes(text: str, start: int, kind: int, end: int, is_base: bool) -> str:
    """Votes of the labelers as a string of +, - and 0, then the length class."""
    body, before = text[start:end], text[max(0, start - 40) : start]
    name, d = KINDS[kind], digits_of(body)
    shape = is_base or (kind == 5 and body[:3] not in ("000", "666") and body[0] != "9") or (kind == 4 and len(body) >= 16)
    loose = len(d) in (10, 11) if kind == 3 else len(body) >= 8
    if kind == 0:
        known = 1 if re.split(r"[.\s]|dot", body)[-1].strip("])").lower() in DOMAINS else -1
    elif kind == 4:
        known = 1 if body.startswith(SECRET_STARTS) or re.fullmatch(r"[0-9a-fA-F]{32,}", body) else 0
    elif kind == 3:
        known = 1 if re.match(r"(?:\+|\(?0|\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}$)", body) else -1
    else:
        known = 0
    cue = 1 if CUES[name].search(before) else 0
    plain = -1 if PLAIN.search(before) else 0
    variety = len(set(d if kind in (1, 2, 3, 5) else body))
    got = (1 if shape else -1, 1 if loose else -1, known, cue, plain, -1 if variety <= 2 else 0, 1 if variety >= 8 else 0)
    return "".join("-0+"[v + 1] for v in got) + str(min(9, len(body) // 6))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in common.blocks(batches):
        counts = [[], [], [], []]
        base, extra = [], []
        for text in block.column(1).to_pylist():
            text = text or ""
            b = base_spans(text)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in b))
            base.append([{"kind": k, "start": a, "stop": e, "votes": votes(text, a, k, e, True)} for a, k, e in b])
            extra.append([{"kind": k, "start": a, "stop": e, "votes": votes(text, a, k, e, False)} for a, k, e in candidates(text, b)])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("votes", pa.string())]))
        yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, kind), pa.array(extra, kind)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "extra"])


SPAN = "array<struct<kind:int,start:bigint,stop:bigint,votes:string>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base and further spans with votes of every row, settled."""
    common.ship(docs.sparkSession)
    source = docs.select("doc_id", "text")
    schema = source.drop("text").schema
    for c in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(c, "long")
    return common.settle(source.mapInArrow(common.tidy(_found), schema.add("base", T._parse_datatype_string(SPAN)).add("extra", T._parse_datatype_string(SPAN))), "spans")


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene for two classes over counted vote patterns: P(vote | class, labeler) [2, LABELERS, 3] and each pattern's probability of being personal data."""
    votes_of = np.array([["-0+".index(c) for c in v[:LABELERS]] for _, v, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    # start from the majority of votes, the strict shape counting twice
    lean = (votes_of - 1).sum(1) + (votes_of[:, 0] - 1)
    p = np.clip(0.5 + 0.2 * lean, 0.05, 0.95)
    table = np.zeros((2, LABELERS, 3))
    for _ in range(rounds):
        for cls, weight in ((0, n * (1 - p)), (1, n * p)):
            for k in range(LABELERS):
                got = np.bincount(votes_of[:, k], weight, 3) + 1.0
                table[cls, k] = got / got.sum()
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        log = [math.log(q) + np.log(table[cls][np.arange(LABELERS), votes_of]).sum(1) for cls, q in ((0, 1 - prior), (1, prior))]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return table, p


def _features(kind: int, v: str) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * LABELERS + 1)
    x[0], x[1 + kind] = 1, 1
    for k in range(LABELERS):
        x[1 + len(KINDS) + 2 * k + (v[k] == "+")] = v[k] != "0"
    x[-1] = int(v[LABELERS]) / 9
    return x


def fit(patterns: list[tuple[int, str, int]], rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier: ridge logistic regression by Newton steps on the soft labels."""
    if not patterns:
        return np.zeros(1 + len(KINDS) + 2 * LABELERS + 1)
    _, p = reliabilities(patterns)
    x = np.array([_features(k, v) for k, v, _ in patterns])
    n = np.array([c for *_, c in patterns], float)
    n *= WEIGHT / n.sum()  # shares: the size of a corpus must not change the ridge's part
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (n * (q - p)) + w)
    return w


def train(found: DataFrame) -> dict[tuple[int, str], bool]:
    """The classifier's verdict for every vote pattern of the corpus. Patterns are bounded in number."""
    both = found.select(F.explode(F.concat("base", "extra")).alias("s"))
    rows = both.groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    patterns = [(r["kind"], r["votes"], r["n"]) for r in rows]
    w = fit(patterns)
    return {(k, v): bool(_features(k, v) @ w > 0) for k, v, _ in patterns}


def _kept(base: list[dict], extra: list[dict], verdict: dict) -> list[tuple[int, int, int]]:
    return sorted([(s["start"], s["kind"], s["stop"]) for s in base] + [(s["start"], s["kind"], s["stop"]) for s in extra if verdict.get((s["kind"], s["votes"]), False)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def judge(found: DataFrame, verdict: dict) -> DataFrame:
    """found with base_sha256, spans and n_spans (how many there are, of all kinds) instead of its lists."""

    def run(batches):
        for batch in batches:
            base, extra = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            digest = [hashlib.sha256(_joined(_kept(b, [], {})).encode()).hexdigest() for b in base]
            kept = [_kept(b, e, verdict) for b, e in zip(base, extra, strict=True)]
            more = [pa.array(digest, pa.string()), pa.array(map(_joined, kept), pa.string()), pa.array(map(len, kept), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*batch.schema.names[:5], "base_sha256", "spans", "n_spans"])

    return found.mapInArrow(common.tidy(run), found.drop("base", "extra").schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long"))


def redact(docs: DataFrame, verdict: dict) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; n_chars, where present, follows the text."""
    common.ship(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for block in common.blocks(batches):
            out = []
            for text in block.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    more = [s for s in candidates(text, base) if verdict.get((s[1], votes(text, s[0], s[1], s[2], False)), False)]
                    parts, last = [], 0
                    for a, k, b in sorted(base + more):
                        if b <= last:
                            continue
                        parts += [text[last : max(a, last)], f"[{KINDS[k].upper()}]"]
                        last = b
                    text = "".join(parts) + text[last:] if parts else text
                out.append(text)
            columns = list(block.columns)
            columns[at] = pa.array(out, block.column(at).type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in out], block.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(common.tidy(run), docs.schema)


def op8_pii_votes(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judge(found, train(found))
