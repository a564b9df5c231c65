"""Readers, resources, text functions, cache and decisions on small fixtures."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from waymark import schemas as S
from waymark.functions import text as X
from waymark.operators import cache as C
from waymark.operators import gazetteer as G
from waymark.operators import postcode, resolve
from waymark.sources import readers, sinks


def values(df):
    return [tuple(r) for r in df.collect()]


def test_text_lines(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_bytes(b"first address\r\n\r\nthird address\n")
    assert [r["text"] for r in readers.read_addresses(spark, str(p)).collect()] == ["first address", "", "third address"]


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿address , suggested_country,force_suggested_country\n"1 Rue\nParis", fr ,YES\n,de,1\nBerlin,,no\n')
    got = values(readers.read_delimited(spark, str(p)))
    assert got == [("1 Rue\nParis", "FR", True, True), ("Berlin", "", False, False)]
    with pytest.raises(ValueError, match="not found"):
        readers.read_delimited(spark, str(p), column="x")


def test_features(spark, tmp_path):
    folder = tmp_path / "oa" / "sg"
    folder.mkdir(parents=True)
    line = {"type": "Feature", "properties": {"Number": "101A", "STREET": "BAYFRONT AVENUE", "unit": "TEMPORARY SITE OFFICE", "city": "", "postcode": "018895", "district": True}}
    (folder / "x-addresses.geojson").write_text(json.dumps(line) + "\n\n" + json.dumps(line | {"properties": {"unit": "NIL"}}) + "\n")
    (folder / "x-buildings.geojson").write_text(json.dumps(line) + "\n")
    want = [("101A BAYFRONT AVENUE\nTEMPORARY SITE OFFICE\n018895", "SG", True, False)]
    assert values(readers.read_directory(spark, str(tmp_path / "oa"))) == want
    assert values(readers.read_directory(spark, str(tmp_path / "oa"), ["fr"])) == []


def test_features_are_parsed_once(spark):
    lines = [
        {"properties": {"NUMBER": 1.5, "number": "2", "Street": " Elm ", "unit": "nil", "city": {"a": 1}, "district": "elm", "region": [1]}},
        {"properties": {"number": None, "street": True, "unit": "U", "district": "u", "region": " R "}},
        {"properties": {}},
        {"type": "Feature"},
        {"properties": None},
    ]
    raw = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(lines)] + [(9, "  ")], "line long, value string")
    got = readers.features(raw)
    assert got.columns == ["line", "value", "text"]
    assert [(r["line"], r["text"]) for r in got.orderBy("line").collect()] == [(0, "1.5 Elm\nelm"), (1, "U\nR")]
    # the filter on the text and its many uses of a property must not bring the parser back for each
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(properties") == 1
    with pytest.raises(Exception, match="line 7: bad JSON: {x"):
        readers.features(spark.createDataFrame([(7, "{x")], "line long, value string")).collect()


def test_requests():
    assert readers.parse_request('{"text": "a"}') == ["a"] and readers.parse_request('{"items": [{"text": "a"}, {"text": "b"}]}') == ["a", "b"]
    for bad in ("{}", '{"text": "a", "items": []}', '{"text": " "}', '{"text": "a", "x": 1}', '{"text": "a"} {}'):
        with pytest.raises(ValueError):
            readers.parse_request(bad)


def test_resources(spark, tmp_path):
    p = tmp_path / "aliases.z"
    p.write_bytes(zlib.compress(json.dumps({"AA": ["Shared"], "ZZ": ["shared ", "Zed"]}).encode()))
    got = dict(values(G.alias_origins(readers.alias_rows(spark, readers.read_zlib_json(spark, str(p))))))
    assert got["SHARED"] == ["AA", "ZZ"] and got["ZED"] == ["ZZ"]
    towns = spark.createDataFrame([("Saint-Pierre", "FR", 5000, 0), ("Saint Pierre", "CA", 7000, 1), ("", "FR", 9, 2)], "name string, country string, population int, ord int")
    index = {r["alias"]: (r["population"], r["largest"]) for r in G.town_index(towns).collect()}
    assert index["SAINT-PIERRE"] == (7000, "CA")


def test_text_functions(spark):
    row = spark.createDataFrame([("this needs to be replaced: `test @ Rock´n roll` and ‘–others–‘", "café\\nstraße\r jp")], "a string, b string").select(X.transliterate(F.col("a")), X.clean(F.col("b")), X.normalize_address(F.col("b")), F.size(X.aliases(F.lit("MONT-SAINT-MICHEL")))).first()
    assert row[0] == "this needs to be replaced: 'test a Rock'n roll' and '-others-'"
    assert row[1] == "CAFE\nSTRASSE JP" and row[2] == "CAFE STRASSE JP" and row[3] == 7


def test_too_long(spark):
    df = spark.createDataFrame([(1, "x" * 300)], "addr_id long, text string")
    with pytest.raises(Exception, match="too long"):
        resolve.clean_addresses(df).collect()
    assert resolve.too_long(df).count() == 1


def test_postcodes(spark):
    texts = spark.createDataFrame([(1, "1 RUE TEST, 75001 PARIS"), (2, "CAF 75001"), (3, "ABC12"), (4, "AB-123 X"), (5, "ab-123")], "addr_id long, text string")
    rows = [("FR", "75001", "PARIS", "[0-9]{5}", ""), ("IE", "ABC", "DUBLIN", "[A-Z]{3}", "[0-9]{2}"), ("XX", "AB 123", "TOWN", "[A-Z]{2} [0-9]{3}", "")]
    got = values(postcode.match_postcodes(texts, spark.createDataFrame(rows, "origin string, code string, town string, regex string, suffix string")))
    assert sorted(got) == [(1, 12, 17, "75001", "PARIS", "FR"), (2, 4, 9, "75001", "PARIS", "FR"), (3, 0, 5, "ABC12", "DUBLIN", "IE"), (4, 0, 6, "AB-123", "TOWN", "XX")]


def test_upsert(spark):
    kind = "raw_address string, normalized_address string, source string, town string"
    old = spark.createDataFrame([("a", "A", "human_verified", "X"), ("b", "B", "llm_assisted", "Y")], kind)
    new = spark.createDataFrame([("a2", "A", "crf_pipeline", "N"), ("b2", "B", "crf_pipeline", "N"), ("c", "C", "crf_pipeline", "N")], kind)
    assert sorted(values(C.upsert(old, new))) == [("a2", "A", "human_verified", "X"), ("b2", "B", "crf_pipeline", "N"), ("c", "C", "crf_pipeline", "N")]


def _cache(spark):
    s = "struct<address_line:string,country:string,town:string,postal_code:string,street:string,country_confidence:double,town_confidence:double>"
    hit = ("PARIS", "FR", "PARIS", "", "", 0.99, 0.98)
    return spark.createDataFrame([("PARIS FR", [1.0, 0.0], "human_verified", hit), ("BERLIN DE", [0.0, 1.0], "sonnet_seed", hit)], f"normalized_address string, embedding array<double>, source string, structured {s}")


def _resolver(df):
    return df.select("addr_id", F.col("text").alias("address_line"), F.lit("DE").alias("country"), F.lit("").alias("town"), F.lit("").alias("postal_code"), F.lit("").alias("street"), F.lit(0.9).alias("country_confidence"), F.lit(0.0).alias("town_confidence"))


def test_cascade(spark):
    requests = spark.createDataFrame([(0, "Paris, fr"), (1, "Berlin de"), (2, "Paris FR."), (3, "Pariz FR")], "item long, text string")
    embed = lambda d: d.select("item", F.when(F.col("key").startswith("PARI"), F.array(F.lit(1.0), F.lit(0.05))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    items, upserts = C.convert(requests, _cache(spark), _resolver, embed)
    got = {r["input"]: r for r in items.collect()}
    assert got["Paris, fr"]["served_by"] == "stage1_cache" and got["Paris, fr"]["resolution_status"] == "resolved"
    # its exact entry isn't trusted; of the neighbours the last one examined gives the reason
    assert got["Berlin de"]["fallback_reason"] == "semantic_gate_failed" and got["Berlin de"]["resolution_status"] == "partial"
    assert got["Pariz FR"]["served_by"] == "stage2_pipeline" and got["Pariz FR"]["fallback_reason"] is not None
    assert {r["normalized_address"] for r in upserts.collect()} == {"BERLIN DE", "PARIZ FR"}
    assert {r["fallback_reason"] for r in C.convert(requests, None, _resolver)[0].collect()} == {"stage1_unconfigured"}


def test_combinations(spark):
    addresses = spark.createDataFrame([(1, "", False, "x"), (2, "FR", True, "x"), (3, "", False, "x")], "addr_id long, suggested string, force boolean, text string")
    kind = "addr_id long, origin string, start int, stop int, possibility string, score double, place int, flags array<string>"
    c = spark.createDataFrame([(1, "FR", 0, 2, "FR", 0.8, 1, []), (1, "DE", 9, 11, "DE", 0.9, 2, []), (2, "DE", 0, 2, "DE", 0.9, 1, [])], kind)
    t = spark.createDataFrame([(1, "FR", 3, 8, "PARIS", 0.86, 1, []), (1, "DE", 12, 18, "BERLIN", 0.94, 2, [])], kind)
    got = [(r["addr_id"], r["country"], r["town"], round(r["score"], 3)) for r in resolve.combinations(c, t, addresses).orderBy("addr_id", "number").collect()]
    assert got[:2] == [(1, "DE", "BERLIN", 0.92), (1, "FR", "PARIS", 0.83)] and len([g for g in got if g[0] == 1]) == 6
    assert got[-2:] == [(2, S.NO_COUNTRY, S.NO_TOWN, 0.15), (3, S.NO_COUNTRY, S.NO_TOWN, 0.15)]


def test_no_table_of_addresses_is_broadcast(spark, tmp_path):
    # by the size of their files all of these tables would be sent out through the driver
    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    head = spark.createDataFrame([(1, "", False, "PARIS\nFR")], "addr_id long, suggested string, force boolean, text string")
    kind = "addr_id long, kind int, start int, stop int, matched string, possibility string, dist int, flags array<string>, origin string, crf double, place int, score double"
    c = spark.createDataFrame([(1, 1, 6, 8, "FR", "FR", 0, [], "FR", 0.5, 1, 0.8)], kind)
    t = spark.createDataFrame([(1, 0, 0, 5, "PARIS", "PARIS", 0, [], "FR", 0.5, 1, 0.9)], kind)
    head, c, t = stored(head, "head"), stored(c, "c"), stored(t, "t")
    index = spark.createDataFrame([("PARIS", 2_000_000, "FR")], "alias string, population long, largest string")
    none = spark.createDataFrame([], "possibility string, origins array<string>")
    found = resolve.town_flags(t, head, index)
    flagged = resolve.country_flags(c, head, G.ReferenceData(none, none, none, index))
    towns, countries = resolve.relationships(t, c, head)
    combos = resolve.combinations(c, t, head)
    rows = resolve.structured(combos, head)
    for df in (found, flagged, towns, countries, combos, rows, resolve.suggested(c, head, 0.95)):
        assert "BroadcastHashJoin [addr_id" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["country"], r["town"]) for r in rows.collect()] == [("FR", "PARIS")] and "IS_METROPOLIS" in found.first()["flags"]


def test_the_driver_holds_little(spark):
    from waymark.settle import settle

    # an address without any match keeps its placeholder, and the joins that make combinations stand in the plan once
    addresses = spark.createDataFrame([(1, "", False, "x"), (2, "", False, "x"), (3, S.NO_COUNTRY, False, "x")], "addr_id long, suggested string, force boolean, text string")
    kind = "addr_id long, origin string, start int, stop int, possibility string, score double, place int, flags array<string>"
    c, t = spark.createDataFrame([(1, "FR", 0, 2, "FR", 0.8, 1, [])], kind), spark.createDataFrame([(1, "FR", 3, 8, "PARIS", 0.86, 1, [])], kind)
    combos = resolve.combinations(c, t, addresses)
    plan = combos._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join Inner") == 5
    got = sorted((r["addr_id"], r["country"], r["town"], r["phase"]) for r in combos.collect())
    assert got[:2] == [(1, "FR", "NO TOWN", 1), (1, "FR", "PARIS", 0)] and got[3:] == [(2, S.NO_COUNTRY, S.NO_TOWN, 3), (3, S.NO_COUNTRY, S.NO_TOWN, 3)]
    # the transliteration of a name stands in the plan once, however often its aliases use it
    names = spark.createDataFrame([("fr", "Saint Étienne"), ("de", None)], "origin string, name string")
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(names.select(X.aliases(X.lookup_name(F.col("name"))))) < 1.5 * size(names.select(X.lookup_name(F.col("name"))))
    assert [r["alias"] for r in G.alias_origins(names).orderBy("alias").collect()] == sorted(["SAINT ETIENNE", "SAINT-ETIENNE", "ST-ETIENNE", "ST ETIENNE", "ST. ETIENNE", "ST.-ETIENNE"])
    # what a settled step leaves behind is collected
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert settle(names, "names").count() == 2 and full() > before


def test_percent(spark):
    rng = [i / 80000 for i in range(0, 80001, 7)]
    got = spark.createDataFrame([(x,) for x in rng], "x double").select(sinks.percent(F.col("x"))).collect()
    assert [r[0] for r in got] == ["%.2f%%" % (x * 100) for x in rng]


def test_stream(spark, tmp_path):
    from waymark.streaming.convert import convert_stream

    spark.createDataFrame([(1, "Paris"), (2, "Berlin")], "item long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("item long, text string").json(str(tmp_path / "in"))
    out = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n)))
    convert_stream(stream, lambda: None, lambda df, n: df.count(), out, _resolver, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "*")).count() == 2
