"""The model path, loaders, plugs and whole jobs on small fixtures."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import cli
from waymark import settle as T
from waymark.operators import cache as C
from waymark.operators import gazetteer as G
from waymark.operators import resolve, seqmodel, services, tagging
from waymark.sources import readers, sinks

STATES = [("OTHER", "OTHER"), ("B", "TOWN"), ("I", "TOWN")]


def runner(provider, **options):
    return tagging.ModelRunner(provider, seqmodel.Crf([0.0] * 3, [0.0] * 3, [[0.0] * 3] * 3), STATES, ["FR", "DE"], **options)


def test_islands():
    tags = [("I", "TOWN"), ("B", "TOWN"), ("I", "TOWN"), ("B", "TOWN"), ("OTHER", "OTHER"), ("I", "TOWN"), ("I", "COUNTRY")]
    assert tagging.islands(tags, True) == [(0, 1, "OTHER"), (1, 3, "TOWN"), (3, 4, "TOWN"), (4, 7, "OTHER")]
    assert tagging.islands(tags, False) == [(0, 4, "TOWN"), (4, 5, "OTHER"), (5, 6, "TOWN"), (6, 7, "COUNTRY")]
    assert tagging.islands([], True) == []


def test_runner_checks():
    for bad in ({"provider": None}, {"max_length": 0}, {"tags": []}, {"tags": STATES[:2]}):
        with pytest.raises(ValueError):
            tagging.ModelRunner(**({"provider": seqmodel.EmissionProvider(), "crf": seqmodel.Crf([0.0] * 3, [0.0] * 3, [[0.0] * 3] * 3), "tags": STATES, "countries": []} | bad))


def test_model_to_resolver(spark):
    """Emissions of a recorded model give spans, series and scores that the resolver uses."""
    text = "12 RUE X\nPARIS FR"
    on = [(0, 9.0) if not 9 <= k < 14 else (1 if k == 9 else 2, 9.0) for k in range(len(text))]
    emissions = [[v if j == s else 0.0 for j in range(3)] for s, v in on]
    table = spark.createDataFrame([(1, emissions, [4.0, 0.0])], "addr_id long, emissions array<array<double>>, country_logits array<double>")
    addresses = spark.createDataFrame([(1, text, "", False)], "addr_id long, text string, suggested string, force boolean")
    rows, probabilities = runner(seqmodel.EmissionProvider(table=table)).tag(addresses)
    row = rows.collect()[0]
    assert [(s["start"], s["stop"], s["tag"]) for s in row["spans"]] == [(0, 9, "OTHER"), (9, 14, "TOWN"), (14, 17, "OTHER")]
    assert row["head"]["country"] == "FR" and row["predictions"][1]["text"] == "PARIS" and row["predictions"][1]["confidence"] > 0.99
    series = {r["tag"]: r["series"] for r in probabilities.collect()}
    assert np.mean(series["TOWN"][9:14]) > 0.99 and max(series["TOWN"][:9]) < 0.01
    countries = spark.createDataFrame([("FR", "France")], "origin string, name string")
    towns = spark.createDataFrame([("Paris", "FR", 2000000, 0), ("Rue", "FR", 3000, 1)], "name string, country string, population int, ord int")
    ref = G.ReferenceData.build(countries, towns)
    got = resolve.resolve(rows, ref, probabilities=probabilities)
    best = got.collect()[0]
    assert (best["country"], best["town"], best["input"]) == ("FR", "PARIS", text) and best["town_confidence"] > 0.95
    plain = resolve.resolve(addresses, ref).collect()[0]
    assert plain["town_confidence"] != best["town_confidence"]
    T.release(got)


def test_load_folder(spark, tmp_path):
    (tmp_path / "misc").mkdir()
    put = lambda name, value: (tmp_path / G.FILES[name]).write_bytes(zlib.compress(json.dumps(value).encode()))
    put("countries", {"us": ["United States", "USA"], "fr": ["France"]})
    put("provinces", {"us": ["NY"]})
    put("specs", {"FR": {"domain_extensions": [".fr"], "postal_code_regex": "[0-9]{5}"}})
    put("town_aliases", {"Paris": ["Lutetia"]})
    (tmp_path / G.FILES["same_name"]).write_text(json.dumps({"Singapore": "sg"}))
    spark.createDataFrame([("Paris", "FR", 2000000)], "name string, `country code` string, population int").write.parquet(str(tmp_path / G.FILES["towns"]))
    ref = G.ReferenceData.load(spark, str(tmp_path))
    known = {r["possibility"]: r["origins"] for r in ref.countries.collect()}
    assert (known["NY"], known["USA"], known["FRANCE"]) == (["US"], ["US"], ["FR"])
    assert {r["alias"]: r["population"] for r in ref.town_index.collect()} == {"PARIS": 2000000, "LUTETIA": 2000000}
    assert ref.same_name.collect()[0][:] == ("SINGAPORE", "SG") and ref.specs.count() == 1 and ref.provinces.collect()[0]["alias"] == "NY"
    assert G.resolve_path("a/", "b") == "a/b" and G.resolve_path("a", "/b") == "/b" and G.resolve_path("a", "s3://b") == "s3://b"
    (tmp_path / "in.txt").write_text("Paris\nFrance\n")
    out = tmp_path / "out.csv"
    assert cli.main(["-i", str(tmp_path / "in.txt"), "-o", str(out), "--resources-dir", str(tmp_path), "-v"]) == 0
    rows = spark.read.csv(str(out), header=True, escape='"').collect()
    assert len(rows) == 2 and rows[0]["1th_best_town"] == "PARIS" and rows[1]["1th_best_country_resolved_code"] == "FR" and rows[0]["country_head_prediction"] == "Country head disabled"


def test_cli_flags(capsys):
    assert cli.main(["--version"]) == 0 and cli.VERSION in capsys.readouterr().out
    for bad in (["-i", "a.txt"], ["-o", "a.csv"], ["-i", "a.txt", "-o", "a.xml"], ["-i", "a.pdf", "-o", "a.csv"], ["--nothing"]):
        assert cli.main(bad) == 2
    assert cli.main(["--help"]) == 0


def test_readers(spark, tmp_path):
    (tmp_path / "bad.geojson").write_text('{"type": "Feature", "properties": {"city": "X"}}\nnot json\n')
    with pytest.raises(Exception, match="bad JSON"):
        readers.read_geojson(spark, str(tmp_path / "bad.geojson")).collect()
    (tmp_path / "x.json").write_text('{"a": [1]}')
    assert readers.read_json(spark, str(tmp_path / "x.json")) == {"a": [1]}
    assert readers.read_tags(["OTHER", "B-TOWN", {"bio": "I-", "tag": "TOWN"}]) == [("OTHER", "OTHER"), ("B", "TOWN"), ("I", "TOWN")]
    for bad in ([1], ["X-TOWN"], ["B-NOWHERE"]):
        with pytest.raises(ValueError):
            readers.read_tags(bad)
    crf = readers.read_crf({"start_transitions": [0.0], "end_transitions": [1.0], "transitions": [[2.0]], "transitions_order_2": [[0.5]]})
    assert crf.step.tolist() == [[2.5]] and crf.end == [1.0]


def test_embedders(spark):
    rows = spark.createDataFrame([(1, "PARIS FR"), (2, "PARIS  FR"), (3, "")], "item long, key string")
    got = {r["item"]: r["embedding"] for r in services.embedder("hashed", width=16)(rows).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and sum(a * b for a, b in zip(got[1], got[2], strict=True)) > 0.5
    post = lambda url, body, key: {"data": [{"index": k, "embedding": [float(len(t))]} for k, t in enumerate(body["input"])]}
    assert [r["embedding"] for r in services.embedder("openai", base="http://h/v1", model="m", post=post)(rows).orderBy("item").collect()] == [[8.0], [9.0], [0.0]]

    def down(url, body, key):
        raise OSError("no service")

    assert {r["embedding"] for r in services.http_embedder("http://h", "m", post=down)(rows).collect()} == {None}
    assert services.service_url("http://h/v1/", "/v1/embeddings") == "http://h/v1/embeddings" == services.service_url("http://h", "/v1/embeddings")
    with pytest.raises(ValueError, match="unknown"):
        services.embedder("abacus")


def test_fill(spark):
    kind = "addr_id long, input string, address_line string, country string, town string, postal_code string, street string, country_confidence double, town_confidence double, status string, band string, reason string"
    rows = [(1, "Paris, fr", "PARIS, FR", "FR", "PARIS", "", "", 0.97, 0.96, "resolved", "high", "high_confidence"), (2, "Bérlin", "BERLIN", "DE", "", "", "", 0.9, 0.0, "partial", "medium", "missing_town"), (3, "lyon", "LYON", "", "LYON", "", "", 0.0, 0.9, "partial", "medium", "missing_country")]
    resolved = spark.createDataFrame(rows, kind)
    listed = "addr_id long, text string, countries array<struct<code:string,score:double>>, towns array<struct<name:string,country_code:string,score:double>>"
    requests = spark.createDataFrame([(i, "t", [("DE", 0.9)], [("BERLIN", "DE", 0.8)]) for i in (1, 2, 3)], listed)
    said = json.dumps({"resolved": True, "country": "de", "town": "Berlin"})
    judge = services.http_judge("http://h", "m", post=lambda url, body, key, timeout: {"choices": [{"message": {"content": said if body["temperature"] == 0 else "{}"}}]})
    cache = spark.createDataFrame([("old", "PARIS FR", "human_verified", "X", [9.0])], "raw_address string, normalized_address string, source string, town string, embedding array<double>")
    got = services.fill(resolved.where("addr_id < 3"), cache, embed=services.hashed_embedder(4), judge=judge, requests=requests)
    after = {r["normalized_address"]: r for r in got["cache"].collect()}
    assert after["PARIS FR"]["source"] == "human_verified" and after["PARIS FR"]["raw_address"] == "Paris, fr" and after["BERLIN"]["source"] == "llm_assisted" and after["BERLIN"]["town"] == "BERLIN"
    assert got["summary"].collect()[0].asDict() == {"processed": 2, "cached": 2, "review": 0, "skipped": 0}
    dry = services.fill(resolved, None, dry_run=True)
    assert dry["summary"].collect()[0].asDict() == {"processed": 3, "cached": 0, "review": 2, "skipped": 2} and {r["input"] for r in dry["review"].collect()} == {"Bérlin", "lyon"}
    for bad in ({}, {"dry_run": True, "judge": judge}):
        with pytest.raises(ValueError):
            services.fill(resolved, None, **bad)


def test_blank_request(spark):
    requests = spark.createDataFrame([(0, "Paris"), (1, " ,. ")], "item long, text string")
    resolver = lambda d: d.select("addr_id", *[F.lit("").alias(c) for c in ("address_line", "country", "town", "postal_code", "street")], *[F.lit(0.0).alias(c) for c in ("country_confidence", "town_confidence")])
    with pytest.raises(Exception, match="text is required"):
        C.convert(requests, None, resolver)


def test_cache_error(spark):
    s = "struct<address_line:string,country:string,town:string,postal_code:string,street:string,country_confidence:double,town_confidence:double>"
    cache = spark.createDataFrame([("PARIS", [1.0], "human_verified", ("P", "FR", "PARIS", "", "", 1.0, 1.0), True)], f"normalized_address string, embedding array<double>, source string, structured {s}, failed boolean")
    got = C.stage1(spark.createDataFrame([(0, "paris")], "item long, text string"), cache, None).collect()[0]
    assert not got["served"] and got["reason"] == "cache_error"


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "FR", "X", "fr", "x"), ("a", "FR", "Y", "DE", "Y")], "stratum string, expected_country string, expected_town string, actual_country string, actual_town string")
    from waymark.operators import evaluate as V

    got = services.report(V.accuracy(rows), limit=2)
    assert got["run"] == {"limit": 2} and got["overall"]["country_correct"] == 1 and got["overall"]["town_correct"] == 2 and got["strata"][0]["stratum"] == "a"
    assert sinks.error("invalid_request", "m") == (400, {"error": {"code": "invalid_request", "message": "m"}}) and sinks.error("x", "m")[0] == 500


def test_scripts(spark):
    from waymark.functions import text as X

    rows = ["Москва", "Αθήνα", "Nẵng Ṣūr", "€ № ẞ", "Щука", "plain @`", "日本"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(X.transliterate(F.col("t"))).collect()]
    assert got == ["Moskva", "Athena", "Nang Sur", "EUR No SS", "Shchuka", "plain a'", ""]
