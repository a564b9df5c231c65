"""The pipeline's stages, each on what its predecessor kept, against plain restatements."""

import random

from waymark.llm import op03_word_bpe, op08_pii

import corpus_pipeline

from .test_operators import LOWER, plain_components, plain_spans, stats


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [" ".join(r["text"].translate(LOWER).split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(1, 6), strict=True):
        out = corpus_pipeline.common.settle(stage(spark, docs, sf), "test")
        after = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(after)
        if number < 5:
            assert out.columns == docs.columns
        if number == 1:
            for i, t in before.items():
                n, _, _, _, repeated = stats(t)
                if n < 50 or 100 * repeated > 50 * n:
                    assert i not in after
        if number == 2:
            assert set(after) == {i for i, (_, c) in plain_components(list(before.items()), 5, 80).items() if c == i}
        if number == 3:
            assert not any(x in " ".join(r["text"].translate(LOWER).split()) for r in after.values() for x in items) and len(after) > 0.8 * len(before)
        if number == 4:
            assert set(after) == set(before)
            for i, r in after.items():
                assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
                assert r["text"] == before[i] or plain_spans(before[i]) or op08_pii.candidates(before[i], [])
        if number == 5:
            t = op03_word_bpe.tokenizer(op03_word_bpe.vocabulary())
            for i, text in before.items():
                assert list(after[i]["ids"]) == t.encode(text, add_special_tokens=False).ids and after[i]["n_tokens"] == len(after[i]["ids"])
        else:
            before = {i: r["text"] for i, r in after.items()}
        docs = out


def test_repeated_and_null_ids(spark, sf):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(90))
    same = text()
    rows = [(1, same), (1, same), (2, same), (3, text()), (None, text()), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.common.settle(stage(spark, df, sf), "test")
    assert {r["doc_id"] for r in df.collect()} <= {1, 3, None} and df.where("doc_id = 1").count() == 1


def test_rows_of_one_id(spark, sf):
    """Rows that share an id, or have none, are judged one by one: a bad one takes no other with it, and different texts all stay."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(90))
    a, b, c, d = text(), text(), text(), text()
    rows = [(7, a), (7, b), (7, "too short"), (None, c), (None, d), (None, None), (None, c), (8, text())]
    df = spark.createDataFrame([(i, t, "en", "s", None, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _uid boolean")
    kept = corpus_pipeline.quality(spark, df, sf)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if t and len(t) > 20)
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.common.settle(kept, "test"), sf)
    assert left.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(7, a), (7, b), (0, c), (0, d), (8, rows[-1][1])])
