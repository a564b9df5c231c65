"""The fuzzy dictionary join against fixed cases and a brute-force restatement."""

import random

import pytest

from pyspark.sql import functions as F

from waymark.operators import fuzzy

CASES = [
    ("SHIP FROM FR VIA FROST", {"fr": ["FR"]}, 50, 1, [(10, 12, "FR", 0, "FR", False)]),
    ("DESTINATION PAR1S", {"PARIS": ["FR"]}, 50, 1, [(12, 17, "PAR1S", 1, "FR", False)]),
    ("MILITARY BASE", {"MILI": ["XX"]}, 50, 0, [(0, 4, "MILI", 0, "XX", True)]),
    ("PAR\nIS", {"PARIS": ["FR"]}, 50, 1, [(0, 6, "PAR\nIS", 0, "FR", False)]),
    ("SPRINGFIELD", {"SPRINGFIELD": ["US", "CA"]}, 50, 1, [(0, 11, "SPRINGFIELD", 0, "CA", False), (0, 11, "SPRINGFIELD", 0, "US", False)]),
    ("PARIS", {"paris": ["FR", "FR", "EU"], "PARIS": ["FR"]}, 50, 1, [(0, 5, "PARIS", 0, "EU", False), (0, 5, "PARIS", 0, "FR", False)]),
    ("ABC", {"": ["EMPTY"]}, 0, 1, []),
    ("ABCDEF", {"ABCDEFGHIJ": ["XX"]}, 50, 4, [(0, 6, "ABCDEF", 4, "XX", False)]),
]


@pytest.mark.parametrize("text, entries, cutoff, tolerance, want", CASES)
def test_cases(spark, text, entries, cutoff, tolerance, want):
    texts = spark.createDataFrame([(1, text)], "addr_id long, text string")
    rows = spark.createDataFrame(list(entries.items()), "possibility string, origins array<string>")
    got = fuzzy.match_dictionary(texts, rows, cutoff=cutoff, tolerance=tolerance).collect()
    assert sorted((r["start"], r["stop"], r["matched"], r["dist"], r["origin"], "IS_INSIDE_ANOTHER_WORD" in r["flags"]) for r in got) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(text, entry, cutoff=80, tolerance=1):
    d = 0 if len(entry) <= 2 else tolerance
    found = [(edits(text[s : s + w], entry), s, s + w) for w in range(max(1, len(entry) - d), len(entry) + d + 1) for s in range(len(text) - w + 1)]
    found = sorted(x for x in found if x[0] <= d)
    ratio = max([100 if k == 0 else 100 * (max(len(entry), e - s) - k) // max(len(entry), e - s) for k, s, e in found], default=0)
    out = []
    for k, s, e in found if ratio >= cutoff else []:
        if all(e <= a or s >= b for _, a, b in out):
            out.append((k, s, e))
    return sorted(out)


def test_random(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ABC ") for _ in range(rng.randint(1, 14)))) for i in range(60)]
    entries = sorted({"".join(rng.choice("ABC") for _ in range(rng.randint(1, 8))) for _ in range(40)})
    rows = spark.createDataFrame([(e,) for e in entries], "possibility string")
    pairs = fuzzy.seeded(spark.createDataFrame(texts, "addr_id long, text string"), rows, 1)
    pairs = pairs.withColumn("found", fuzzy.within(F.col("text"), F.col("possibility"), F.col("d"), F.col("bases"))).where(fuzzy.open_gate(F.col("found"), F.col("possibility"), 80))
    got = pairs.select("addr_id", "possibility", F.explode(fuzzy.greedy(F.col("found"))).alias("w")).select("addr_id", "possibility", "w.*").collect()
    have = sorted((r["addr_id"], r["possibility"], r["dist"], r["start"], r["stop"]) for r in got)
    assert have == sorted((i, e, *x) for i, t in texts for e in entries for x in brute(t, e))


def test_windows_are_made_once(spark):
    texts = spark.createDataFrame([(1, "ABCDE"), (2, "XABDEX")], "addr_id long, text string")
    entries = spark.createDataFrame([("ABCDE", ["A"])], "possibility string, origins array<string>")
    got = fuzzy.match_dictionary(texts, entries)
    assert sorted((r["addr_id"], r["start"], r["stop"], r["dist"]) for r in got.collect()) == [(1, 0, 5, 0), (2, 1, 5, 1)]
    # the gate's filter must not bring the windows back
    assert got._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
