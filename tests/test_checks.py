"""Checks of tiles, sets, lists and tags, on cases written out and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import listcheck, sets, tagging, tilecheck
from wayfold.operators.namelist import TILE_KEYS
from wayfold.operators.naming import LOCAL, Variety

DIALECT = TILE_KEYS["dialect"]

FEATURE = "n int, osm string, props map<string,string>, lon double, lat double, extra int"
ENTRY = "id string, osm string, kind string, name_de string, names map<string,string>, lon double, lat double, extra string"


def plain_disagreements(features, entries, tags):
    by_id, out, held = {e["id"]: e for e in entries}, [], set()
    for f in features:
        e = by_id.get(f["props"].get("place:ref"))
        if e is None:
            continue
        square = f["props"].get("place:square") == "yes"
        first = (e["osm"] or "").split("; ")[0]
        if not (square or first.startswith("local/") or (f["osm"] and f["osm"] == first)):
            continue
        held.add(e["id"])
        want = [("kind", "place:kind", e["kind"] or None)] + ([("name_de", "name:de", e["name_de"])] if e["name_de"] else []) + [(f"names[{t}]", f"name:{t}", e["names"].get(t)) for t in tags]
        out += [(f["n"], e["id"], f["osm"], field, key, said, f["props"].get(key)) for field, key, said in want if said != f["props"].get(key)]
        fixed = square or not f["osm"] or f["osm"].startswith("node/")
        if f["lon"] is not None and fixed and math.dist((f["lon"], f["lat"]), (e["lon"], e["lat"])) > 1e-4:
            out.append((f["n"], e["id"], f["osm"], "position", None, f"{e['lat']:.5f}, {e['lon']:.5f}", f"{f['lat']:.5f}, {f['lon']:.5f}"))
    return out, held


def test_tiles_are_held_against_entries_like_a_plain_loop(spark):
    r = random.Random(5)
    entries = [{"id": f"e{i}", "osm": r.choice([None, "", "node/1", "way/2; node/1", "local/x", "relation/3"]), "kind": r.choice(["island", "", None]), "name_de": r.choice(["A", "", None]), "names": r.choice([{}, {"a": "x"}, {"a": "y", "b": "z"}]), "lon": 8.0, "lat": 54.0, "extra": "e"} for i in range(12)]
    features = []
    for n in range(300):
        props = {"place:ref": f"e{r.randrange(15)}"} | r.choice([{}, {"place:square": "yes"}, {"place:square": "no"}]) | r.choice([{}, {"place:kind": "island"}, {"place:kind": ""}]) | r.choice([{}, {"name:de": "A"}]) | r.choice([{}, {"name:a": "x"}, {"name:a": "y", "name:b": "z"}])
        at = r.choice([(None, None), (8.0, 54.0), (8.00009, 54.0), (8.00009, 54.00009)])
        features.append({"n": n, "osm": r.choice([None, "node/1", "way/2", "relation/3"]), "props": props, "lon": at[0], "lat": at[1], "extra": 1})
    features.append({"n": 300, "osm": None, "props": {}, "lon": None, "lat": None, "extra": None})
    f, e = spark.createDataFrame([tuple(x.values()) for x in features], FEATURE), spark.createDataFrame([tuple(x.values()) for x in entries], ENTRY)
    want, held = plain_disagreements(features, entries, ["a", "b"])
    assert {x[3] for x in want} == {"kind", "name_de", "names[a]", "names[b]", "position"}
    got = tilecheck.disagreements(f, e, ["a", "b"], ("n",))
    assert got.columns == ["n", "id", "osm", "field", "key", "said", "shown"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {x.id for x in tilecheck.checked_entries(f, e).collect()} == held
    assert tilecheck.disagreements(f.limit(0), e, ["a"]).count() == tilecheck.checked_entries(f, e.limit(0)).count() == 0


def test_sets_of_keys(spark):
    rows = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k string, other int")
    a, b = rows("x", "x", "y", None, ""), rows("y", "z", "z", None)
    assert sorted(r.key for r in sets.either(a, b, "k").collect()) == ["x", "y", "z"] and sorted(r.key for r in sets.keys(a, "k").collect()) == ["x", "y"]
    assert sorted(map(tuple, sets.installed(a, b, "k").collect())) == [("x", "missing"), ("z", "extra")]
    assert sets.installed(a, a, "k").count() == sets.installed(rows(), rows(), "k").count() == 0
    names = spark.createDataFrame([(1, "A", "way/1; node/2", "Q1", ""), (2, "B", "node/2", "Q2", "ok"), (3, "C", "local/c", None, None), (4, "D", "way/9", "Q9", "skip"), (5, "E", "road/1", "Q2", None)], "line int, name string, osm string, wikidata string, status string")
    found, items = spark.createDataFrame([("w", 1), ("n", 9)], "t string, id long"), spark.createDataFrame([("Q1",)], "item string")
    assert sorted(map(tuple, sets.not_found(names, found, items).collect())) == [("item", "Q2", "B"), ("reference", "node/2", "A")]


CELLS = ["id", "kind", "one", "local", "two", "de", "da", "hint", "osm", "wikidata", "status", "note"]
TUNED = ["osm", "lat", "lon", "set_tags", "minzoom", "maxzoom", "polygon_km2"]
REGISTRY = ["tag", "language", "column", "label", "status", "view"]


def table(spark, columns, *rows):
    return spark.createDataFrame([(n, *[r.get(c) for c in columns]) for n, r in rows], "line int, " + ", ".join(f"`{c}` string" for c in columns))


@pytest.fixture(scope="module")
def lists(spark):
    names = table(
        spark, CELLS, (2, {"id": "a", "kind": "island", "one": "x", "osm": "way/1; node/2", "wikidata": "Q1"}), (3, {"id": "a", "kind": "moon", "one": "x (y", "osm": "node/2;way/3", "status": "ok"}),
        (4, {"kind": "island", "de": "z?", "osm": "way/7; way/7", "wikidata": "Q1"}), (5, {"id": "b", "kind": "island", "osm": "local/gone"}), (6, {"id": "c", "kind": "island", "osm": "local/there"}),
        (7, {"id": "d", "kind": "island", "osm": "way/1", "status": "skip"}),
    )
    tuned = table(spark, TUNED, (2, {"osm": "local/there", "lat": "54", "lon": "8"}), (3, {"osm": "local/gone"}), (4, {"osm": "way/5", "set_tags": "place:ref=a"}), (5, {"osm": "way/6", "set_tags": "place:ref=zz"}))
    good = {"language": "frr", "label": "L", "status": "living", "view": "yes"}
    registry = table(spark, REGISTRY, (2, good | {"tag": "frr-x-a", "column": "one"}), (3, {}), (4, good | {"tag": "frr-x-b", "column": "two"}))
    areas = table(spark, ["dialect", "osm", "name"], (2, {"dialect": "frr-x-a", "osm": "way/1"}), (3, {"dialect": "frr-x-c", "osm": "way/2"}), (4, {"dialect": "frr-x-b", "osm": "way/1"}))
    return names, tuned, registry, areas, good


def told(df):
    return [(r.file, r.line, r.message) for r in df.orderBy("part", "line", "rank", "seq", "message").collect()]


def test_all_problems_of_all_lists_in_order(spark, lists):
    names, tuned, registry, areas, _ = lists
    assert told(listcheck.all_problems(names, tuned, registry, areas)) == [
        ("names", 3, "unknown kind 'moon'"), ("names", 3, "id of an earlier line"), ("names", 3, "node/2 is held by line 2 already"), ("names", 3, "one: unbalanced brackets"), ("names", 3, "osm: references are separated by `; `"),
        ("names", 4, "no id"), ("names", 4, "Q1 is held by line 2 already"), ("names", 4, "way/7 twice in `osm`"), ("names", 4, "de: `?` in 'z?' -- say `uncertain` in `note` instead"),
        ("names", 5, "local/gone has no row with a position"), ("tuning", 3, "a local reference needs a position"), ("tuning", 5, "place:ref=zz names no row of the name list"),
        ("areas", 3, "unknown dialect 'frr-x-c'"), ("areas", 4, "way/1 is already on line 2"),
    ]


def test_an_unsound_registry_leaves_areas_out_and_an_empty_one_the_names(spark, lists):
    names, tuned, _, areas, good = lists
    half = table(spark, REGISTRY, (2, good | {"tag": "frr-x-a", "column": "one"}), (3, good | {"tag": "frr-x-b", "column": "local"}))
    got = told(listcheck.all_problems(names, tuned, half, areas))
    assert ("registry", 3, "a reserved column") in got and {f for f, _, _ in got} == {"names", "tuning", "registry"}
    none = table(spark, REGISTRY, (2, good | {"tag": "frr-x-b", "column": "local"}))
    assert {f for f, _, _ in told(listcheck.all_problems(names, tuned, none, areas))} == {"tuning", "registry"}
    assert told(listcheck.all_problems(names, tuned.limit(0), none.limit(0), areas)) == []


def test_a_name_list_without_its_columns_has_that_problem_only(spark, lists):
    names, tuned, registry, areas, _ = lists
    got = told(listcheck.all_problems(names.drop("two", "note"), tuned, registry, areas.limit(0)))
    assert [x for x in got if x[0] == "names"] == [("names", 1, "missing columns: note, two")]


def ring(x, y, side):
    """The outline of a square, with the area on the left."""
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_tags_go_by_row_then_own_name_then_tuning(spark):
    rings = spark.createDataFrame([(tag, 0, 1, 2.0, ring(x, 54.0, 1.0)) for tag, x in (("frr-x-a", 8.0), ("nds", 9.5), ("other", 11.0))], "tag string, polygon long, outer int, doubled double, points array<struct<lon:double,lat:double>>")
    varieties = [Variety("frr-x-a", "one", "frr"), Variety("nds", "two", "nds")]
    spots = [(1, 8.5, "F1", "S1"), (2, 9.9, "F2", "S2"), (3, 9.9, "F3", None), (4, 11.5, "F4", "S4"), (5, 20.0, "F5", "S5"), (6, 8.5, "F6", None), (7, None, "F7", None), (8, 8.5, None, "S8")]
    objects = spark.createDataFrame([("n", i, x, None if x is None else 54.5, None, None, None, f, s) for i, x, f, s in spots], "t string, id long, lon double, lat double, lon2 double, lat2 double, admin_level int, name_frr string, name_nds string")
    named = objects.select("t", "id").union(spark.createDataFrame([("n", 1), ("w", 1), ("n", 99)], "t string, id long"))
    local = tagging.local_names(named, spark.createDataFrame([("n", 6), ("n", 6), ("w", 1)], "t string, id long"), objects, rings, varieties)
    assert sorted((r.t, r.id, dict(r.added)) for r in local.collect()) == [("n", 1, {LOCAL: "F1", DIALECT: "frr-x-a"}), ("n", 2, {LOCAL: "S2", DIALECT: "nds"})]
    claimed = spark.createDataFrame([("n", 1, {"name": "R"}), ("n", 3, {})], "t string, id long, added map<string,string>")
    tuned = spark.createDataFrame([("n", 1, {"name": "", "place": "island"}), ("n", 4, {"x": "y"})], "t string, id long, changes map<string,string>")
    got = tagging.added_tags(objects.withColumns({"added": F.lit("clash"), "how": F.lit(1)}), claimed, local, tuned)
    assert got.columns == [*objects.columns, "added", "how"]
    assert {r.id: (dict(r.added), r.how) for r in got.collect()} == {
        1: ({"name": "", "place": "island"}, "row"), 2: ({LOCAL: "S2", DIALECT: "nds"}, "osm"), 3: ({}, "row"), 4: ({"x": "y"}, None), 5: ({}, None), 6: ({}, None), 7: ({}, None), 8: ({}, None),
    }


def test_list_rows_are_parsed_once_by_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    """Before, a list in one file was parsed by one task, and again by each check and by the order of problems."""
    monkeypatch.setattr(listcheck, "ROWS_OF_TASK", 10)
    rows = spark.range(95).selectExpr("id AS line", "concat('way/', id) AS osm").coalesce(1)
    got = listcheck.dealt(rows, "rows", F.spark_partition_id().alias("task"))
    assert got.select("line").distinct().count() == 95 and got.select("task").distinct().count() == 10


def test_plain_names_are_told_from_those_to_be_looked_at(spark):
    from wayfold.functions.text import cell_problem

    cells = ["Naibel", "Sönke-Nissen Koog 2", "St. Peter's", "", None, " A", "A ", "A  B", "A?", "A; A", "A;B", "A (x", "A (x) b", "A\n", "A\u00a0", "A, A", "A / A", "Å’b #1"]
    got = {r.c: r.m for r in spark.createDataFrame([(c,) for c in cells], "c string").select("c", cell_problem("c").alias("m")).collect()}
    assert all(got[c] is None for c in ("Naibel", "Sönke-Nissen Koog 2", "St. Peter's", "", None, "Å’b #1"))
    assert all(got[c] for c in ("A  B", "A?", "A; A", "A;B", "A (x", "A (x) b"))
