import json
import os

import pytest
from pyspark.sql import functions as F

from wayfold.plans import views
from wayfold.sources import extracts, sinks, tables
from wayfold.streaming import decisions as stream


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿id,name\n a ,"x\ny"\n\nb,c\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(p), ("id",)).orderBy("line").collect()
    assert [(r.line, r.id) for r in rows] == [(2, "a"), (5, "b")]
    for text, what in (("a;b\n1;2\n", "semicolons"), ("a,a\n1,2\n", "repeated"), ("a\n1\n", "missing"), ("id,b\n1\n", "cells")):
        p.write_text(text)
        with pytest.raises(tables.TableError, match=what):
            tables.read_csv(spark, str(p), ("id",))
    header, rows, _ = tables.parse_csv("a,b\n1,2\n")
    assert tables.write_csv(header, [r for _, r in rows]) == "a,b\n1,2\n"


def test_records_log_and_lock(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"extracts": "x-1"}\n{"src": "a", "t": "n", "id": 11711096159, "tags": {"name": "N"}}\n')
    assert [(r.id, r.lon, r.tags) for r in tables.read_records(spark, str(p)).collect()] == [(11711096159, None, {"name": "N"})]
    assert tables.read_header(spark, str(p)) == "x-1"
    p.write_text('{"id": "a", "action": "osm"}\n\nno json\n{"action": "skip"}')
    log = tables.read_log(spark, str(p)).orderBy("line").collect()
    assert [(r.line, r.id, r.bad) for r in log] == [(1, "a", False), (3, None, True), (4, None, False)]
    p.write_text("# c\nKEY=a=b\nother\n")
    assert [tuple(r) for r in tables.read_lock(spark, str(p)).collect()] == [("KEY", "a=b")]


@pytest.fixture
def extract(spark):
    name = {"name": "N", "place": "village", "x": "y"}
    nodes = spark.createDataFrame([(1, 8.0, 54.5, name), (2, 8.2, 54.5, {}), (3, None, None, {"name": "lost", "place": "town"}), (4, 8.0, 54.7, {"place": "village"})], extracts.NODES)
    ways = spark.createDataFrame([(1, [1, 2], {"name": "R", "highway": "primary"}), (2, [], {"name": "E", "natural": "water"}), (3, [4, 4, 4], {"name": "W", "waterway": "river"})], extracts.WAYS)
    members = [("w", 1, "outer"), ("w", 3, ""), ("w", 9, "inner"), ("n", 2, "label")]
    relations = spark.createDataFrame([(1, members, {"name": "Rel", "boundary": "administrative"})], extracts.RELATIONS)
    return extracts.Extract(nodes, ways, relations, "here")


def test_extract_scans(spark, extract, tmp_path):
    extract.write(str(tmp_path))
    x = extracts.Extract.read(spark, str(tmp_path), "here")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(r.id for r in x.by_id("ways", ids).collect()) == [1, 3] and sorted(r.id for r in x.by_id("nodes", ids).collect()) == [1, 2]
    assert {(r.t, r.id) for r in x.tagged("place").collect()} == {("n", 1), ("n", 3), ("n", 4)}
    rel, ways, nodes = x.geometry(spark.createDataFrame([("r", 1)], "t string, id long"))
    assert (rel.count(), sorted(r.id for r in ways.collect()), sorted(r.id for r in nodes.collect())) == (1, [1, 3], [1, 2, 4])
    r = x.relations.select(extracts.ring_members(F.col("members")).alias("m"), extracts.label_node(F.col("members")).alias("l")).first()
    assert (r.m.outer, r.m.inner, r.l) == ([1, 3], [9], 2)


def test_candidates_and_claims(spark, extract):
    got = {(r.t, r.id): r for r in extracts.candidates(extract).collect()}
    assert set(got) == {("n", 1), ("n", 3), ("w", 1), ("w", 2), ("w", 3), ("r", 1)}
    assert got["n", 1].tags == {"name": "N", "place": "village"} and got["w", 1].lon == 8.1 and got["w", 2].lon is None
    assert abs(got["r", 1].lat - 54.6) < 1e-4
    changes = spark.createDataFrame([("n", 1, {"name:frr": "F", "x": ""})], "t string, id long, changes map<string,string>")
    out = {(r.t, r.id): r.tags for r in extracts.with_claims(extract, changes).collect()}
    assert out["n", 1] == {"name": "N", "place": "village", "name:frr": "F"} and out["n", 2] == {}


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "f")
    sinks.replace_file(p, "one", "missing")
    seen = sinks.digest(p)
    sinks.replace_file(p, "two", seen)
    with pytest.raises(sinks.Conflict):
        sinks.replace_file(p, "three", seen)
    assert open(p).read() == "two" and len(os.listdir(tmp_path)) == 1
    with sinks.locked(p + ".lock"), pytest.raises(sinks.Conflict), sinks.locked(p + ".lock"):
        pass
    assert sinks.markdown([("a|b", 1)], ["x", "y"]).splitlines()[-1] == "| a\\|b | 1 |"
    areas = spark.createDataFrame([("x", [(8.0000049, 54.0), (9.0, 54.0), (9.0, 55.0)])], "dialect string, ring array<struct<lon:double,lat:double>>")
    feature = sinks.features(areas, "ring", "dialect").first().value
    assert json.loads(feature)["geometry"]["coordinates"][0][0] == [8.0, 54.0]
    back = sinks.read_features(spark.createDataFrame([(f'{{"type":"FeatureCollection","features":[{feature}]}}',)], "value string")).first()
    assert back.properties == {"dialect": "x"} and len(back.ring) == 3
    rows = spark.createDataFrame([("r", 1, None), ("n", 2, "a"), ("w", 0, "b")], "t string, id long, v string")
    sinks.write_json_in_order(rows, str(tmp_path / "j"), sinks.type_order(F.col("t")), "id")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["t"] for x in lines] == ["n", "w", "r"] and "v" not in lines[-1]


def test_stream_keeps_the_last_line(spark, tmp_path):
    schema = "key string, slot string, line int"
    inbox = str(tmp_path / "in")
    run = lambda: stream.maintain_latest(stream.log_stream(spark, inbox, schema), str(tmp_path / "out"), ["key", "slot"], "line", str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "d", 1), ("a", "d", 3), ("b", "d", 2)], schema).write.mode("append").parquet(inbox)
    run()
    spark.createDataFrame([("a", "d", 2), ("b", "d", 5)], schema).write.mode("append").parquet(inbox)
    run()
    last = sorted(os.listdir(tmp_path / "out"))[-1]
    assert sorted((r.key, r.line) for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()) == [("a", 3), ("b", 5)]


def test_views_are_rebuilt_when_inputs_change(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    vs = [views.View("sum", ["a"], lambda t: t.agg(F.sum("x").alias("s"))), views.View("twice", ["sum"], lambda t: t.select((F.col("s") * 2).alias("s")))]
    root = str(tmp_path)
    assert set(views.build(spark, vs, {"a": a}, root).values()) == {"missing"}
    assert set(views.build(spark, vs, {"a": a.orderBy(F.desc("x"))}, root).values()) == {None}
    why = views.build(spark, vs, {"a": a.union(a)}, root)
    assert why["sum"] == "changed: a" and spark.read.parquet(f"{root}/twice").first().s == 12
