"""CRF, tokenizers, spans and pooling against fixed cases and all paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import seqmodel as M


def test_decode_cases():
    crf = M.Crf([0, 0], [0, 0], [[0, 0], [0, 0]])
    assert crf.decode([[3, 0], [0, 4], [1, 2]]) == [0, 1, 1]
    assert crf.decode([[3, 0], [0, 4]], [True, False]) == [0]
    assert np.allclose(crf.marginals([[1, 1], [1, 1]]), 0.5)
    inf = -math.inf
    assert (crf.marginals([[inf, inf]]) == 0).all()


@pytest.mark.parametrize("emissions, mask", [([[1], [1, 2]], None), ([[1, 2]], [True, False])])
def test_shape_errors(emissions, mask):
    with pytest.raises(ValueError):
        M.Crf([0, 0], [0, 0], [[0, 0], [0, 0]]).decode(emissions, mask)
    with pytest.raises(ValueError):
        M.Crf([0, 0], [0], [[0, 0], [0, 0]])


def test_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t, n = rng.integers(2, 4), rng.integers(1, 5)
        crf = M.Crf(rng.normal(size=t).tolist(), rng.normal(size=t).tolist(), rng.normal(size=(t, t)).tolist(), rng.normal(size=(t, t)).tolist())
        e = rng.normal(size=(n, t))
        paths = {p: crf.start[p[0]] + crf.end[p[-1]] + sum(e[i, x] for i, x in enumerate(p)) + sum(crf.step[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(t), repeat=int(n))}
        assert tuple(crf.decode(e.tolist())) == max(paths, key=paths.get)
        z = sum(math.exp(v) for v in paths.values())
        want = np.array([[sum(math.exp(v) for p, v in paths.items() if p[i] == k) / z for k in range(t)] for i in range(n)])
        assert np.allclose(crf.marginals(e.tolist()), want)


def test_tokens(spark):
    ids, mask = M.char_tokens(F.col("t"), ["U", "S", " ", "N", "Y"], 6)
    row = spark.createDataFrame([("US NY",), ("",)], "t string").select(ids.alias("i"), mask.alias("m")).collect()
    assert row[0]["i"] == [2, 3, 4, 5, 6, 1] and row[0]["m"] == [True] * 5 + [False]
    assert row[1]["i"] == [1] * 6


def test_word_pieces():
    vocabulary = M.read_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "rue", "univers", "##ite"])
    assert M.word_pieces("universite", vocabulary) == [5, 6] and M.word_pieces("xyz", vocabulary) == [1] and M.word_pieces("r" * 101, vocabulary) == [1]
    with pytest.raises(ValueError):
        M.read_vocabulary(["rue"])


def test_pool():
    got = M.mean_pool(np.array([[1.0, 0.0], [0.0, 1.0], [10.0, 10.0]]), [True, True, False])
    assert np.allclose(got, 1 / math.sqrt(2))


def test_strict_spans(spark):
    rows = spark.createDataFrame([(1, 0, "I", "COUNTRY"), (1, 1, "B", "COUNTRY"), (1, 2, "I", "COUNTRY")], "k long, p int, bio string, tag string")
    got = sorted((r["start"], r["stop"], r["tag"]) for r in M.bio_spans(rows, ["k"], ["p"]).collect())
    assert got == [(0, 1, "OTHER"), (1, 3, "COUNTRY")]
