import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.operators import checks, claims, clustering, decisions, geometry, matching, naming, search, spatial, stats

OBJECTS = "src string, t string, id long, lon double, lat double, tags map<string,string>"


def test_index_keeps_best_rank_and_ignores_nameless(spark):
    rows = [
        ("a", "n", 1, 8.9, 54.7, {"name": "Kampen (Sylt)"}), ("a", "n", 2, 8.9, 54.7, {"name": "Kampen"}), ("a", "n", 3, 8.9, 54.7, {"alt_name": "Kampen", "name": "X"}),
        ("a", "n", 4, 8.9, 54.7, {"place": "village"}), ("b", "n", 1, 8.0, 54.0, {"name": "Kampen"}), ("a", "w", 5, None, None, None),
    ]
    index = matching.name_index(spark.createDataFrame(rows, OBJECTS))
    got = {(r.src, r.id): (r["rank"], r.byname) for r in index.where("key = 'kampen'").collect()}
    assert got == {("a", 1): (2, False), ("a", 2): (0, False), ("a", 3): (4, True), ("b", 1): (0, False)}
    hits = matching.lookup(spark.createDataFrame([("r", "KAMPEN"), ("s", None)], "row_id string, name string"), index)
    cands = {r.id: (r["rank"], r.byname, r.src) for r in matching.ranked_candidates(hits).collect()}
    assert cands == {1: (0, False, "b"), 2: (0, False, "a"), 3: (4, True, "a")}


def points(spark, xs, kinds=None):
    rows = [(0, i, kinds[i] if kinds else "n", 8.0, 54.0 + x / 111.19, {}) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g int, id int, t string, lon double, lat double, tags map<string,string>")


def test_clusters_are_greedy_and_never_merge(spark):
    got = clustering.clusters(points(spark, [0, 5, 2.5, 7]), ["g"], ["id"]).orderBy("cluster").collect()
    assert [[m.id for m in r.members] for r in got] == [[0, 2], [1, 3]]
    nowhere = spark.createDataFrame([(0, i, "n", None, None, {}) for i in range(3)], "g int, id int, t string, lon double, lat double, tags map<string,string>")
    lone = clustering.clusters(nowhere, ["g"], ["id"]).collect()
    assert len(lone) == 3 and all(r.lon is None for r in lone)


def test_first_holder_and_problems(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), ("y", 2), ("x", 3)], "thing string, line int")
    assert {(r.thing, r.line) for r in claims.first_holder(df, ["thing"], "line").collect()} == {("x", 1), ("y", 2)}
    got = sorted((r.thing, r.line, r.holder, r.repeated) for r in claims.claim_problems(df, ["thing"], "line").collect())
    assert got == [("x", 3, 1, False), ("x", 3, 1, True), ("y", 2, 2, True)]


def test_claims_in_order_equal_a_fold_over_all(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(2)
    rows = [(r, r, t) for r in range(40) for t in sorted(rng.sample(range(60), rng.randint(1, 3)))]
    taken, want = set(), {}
    for r, g in itertools.groupby(rows, key=lambda x: x[0]):
        free = [t for *_, t in g if t not in taken]
        want[r] = free[0] if free else None
        taken.update(free[:1])
    got = claims.resolve_in_order(spark.createDataFrame(rows, "row long, line long, thing long"), "row", "line", "thing", ["thing"]).collect()
    assert {r.row: r.thing for r in got} == want


def test_within_equals_all_pairs(spark):
    rng = random.Random(4)
    a = [(i, 7.8 + rng.random() * 0.5, 54.2 + rng.random() * 0.5) for i in range(120)] + [(999, None, None)]
    b = [(i, 7.8 + rng.random() * 0.5, 54.2 + rng.random() * 0.5) for i in range(120)]
    left, right = spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "j int, lon double, lat double")
    got = {(r.i, r.j) for r in spatial.within(left, right, 3.0).collect()}
    from wayfold.functions.geo import haversine

    every = left.crossJoin(right.withColumnsRenamed({"lon": "x", "lat": "y"})).where(haversine("lon", "lat", "x", "y") <= 3.0)
    assert got == {(r.i, r.j) for r in every.collect()} and got


def test_within_deals_out_a_full_cell(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS_OF_PART", 50)
    monkeypatch.setattr(spatial, "PAIRS_OF_TASK", 200)
    rng = random.Random(5)
    at = lambda i: (i, 8.0 + rng.random() * 0.01, 54.5 + rng.random() * 0.01)
    left, right = spark.createDataFrame([at(i) for i in range(60)], "i int, lon double, lat double"), spark.createDataFrame([at(i) for i in range(40)], "j int, lon double, lat double")
    pairs = spatial.within(left, right, 3.0)
    by_task = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).withColumnRenamed("count(1)", "n").collect()]
    assert pairs.count() == pairs.select("i", "j").distinct().count() == 60 * 40
    assert len(by_task) > 4 and max(by_task) < 60 * 40 // 2


def test_within_finds_a_pair_straight_north_at_the_very_distance(spark):
    """Rows of cells were lower than the distance by a ten-thousandth of it."""
    high = 100.0 / 111.32 * 1.001
    low = 60 * high + high - 1e-7
    left = spark.createDataFrame([(1, 8.0, low)], "i int, lon double, lat double")
    right = spark.createDataFrame([(1, 8.0, low + 99.999 / 6371.0 * 180 / 3.141592653589793)], "j int, lon double, lat double")
    assert spatial.within(left, right, 100.0).count() == spatial.within(right.withColumnRenamed("j", "i"), left.withColumnRenamed("i", "j"), 100.0).count() == 1


def test_smallest_area_by_ring_and_edge(spark):
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    areas = spark.createDataFrame([("big", [tuple(map(float, p)) for p in box(0, 0, 4)]), ("small", [tuple(map(float, p)) for p in box(1, 1, 1)])], "tag string, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(0, 1.5, 1.5), (1, 3.0, 3.0), (2, 2.0, 2.0), (3, 9.0, 9.0), (4, None, None)], "k int, lon double, lat double")
    assert {r.k: r.tag for r in spatial.smallest_area(pts, areas, ["k"]).collect()} == {0: "small", 1: "big", 2: "small", 3: None, 4: None}


LOG = "line int, id string, action string, ref string"


def test_log_last_line_counts_and_discard_takes_the_decision(spark):
    rows = [(1, "a", "osm", "way/1"), (2, "a", "skip", None), (3, "b", "create", None), (4, "b", "osm", "way/2"), (5, "b", "discard", None), (6, "", "osm", "way/3"), (7, None, "osm", "way/4"), (8, "c", "osm", "way/5"), (9, "c", "clear", None)]
    log = decisions.keyed(spark.createDataFrame(rows, LOG))
    assert sorted(r.line for r in decisions.latest(log).collect()) == [2, 5, 6, 7, 9]
    assert sorted(r.line for r in decisions.decided(log).collect()) == [2] or sorted(r.slot for r in decisions.decided(log).collect())
    assert decisions.created(log).count() == 0
    newer = decisions.keyed(spark.createDataFrame([(20, "a", "osm", "x"), (21, "b", "discard", None)], LOG))
    back = decisions.refused_to_append(log.where("line in (1, 4, 8)"), newer)
    assert [r.line for r in back.collect()] == [8]


def test_apply_refuses_what_is_held(spark):
    rows = spark.createDataFrame([("a", "", ""), ("b", "", ""), ("c", "way/9", "auto")], "id string, osm string, status string")
    log = spark.createDataFrame([(1, "a", "osm", "way/1"), (2, "b", "osm", "way/1"), (3, "c", "skip", None)], LOG)
    got = {r.id: (r.osm, r.status, r.refused) for r in decisions.apply(rows, log, spark.createDataFrame([("way/7", "z")], "claim string, holder string")).collect()}
    assert got == {"a": ("way/1", "ok", False), "b": ("", "", True), "c": ("way/9", "skip", False)}
    held = decisions.apply(rows, log, spark.createDataFrame([("way/1", "z")], "claim string, holder string"))
    assert {r.id: r.refused for r in held.collect()} == {"a": True, "b": True, "c": False}


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, ""), (3, "a"), (4, "B c")], "line int, id string")
    assert {(r.line, r.message) for r in checks.id_problems(rows, "id", "line").collect()} == {(2, "no id"), (3, "id of an earlier line"), (4, "malformed id")}
    a, b = (spark.createDataFrame(x, "label string, digest string") for x in ([("x", "1"), ("y", "2")], [("x", "1"), ("z", "3")]))
    assert sorted(r.label for r in checks.stamp_difference(a, b).collect()) == ["y", "z"]
    p, q = (spark.createDataFrame(x, "k int, n string, v double") for x in ([(1, "a", 1.0), (2, None, 2.0)], [(1, "b", 1.00001), (2, None, 3.0)]))
    assert sorted((r.k, r.field) for r in checks.field_differences(p, q, "k", ["n", "v"], {"v": 1e-4}).collect()) == [(1, "n"), (2, "v")]
    s, t = (spark.createDataFrame(x, "line int, text string") for x in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]))
    assert [tuple(r) for r in checks.first_line_difference(s, t).collect()] == [(2, "b", "c")]
    names = spark.createDataFrame([(1, ["A", "a"]), (2, ["a"]), (3, ["b"])], "k int, n array<string>")
    assert [(r.name, r["keys"]) for r in checks.shared_names(names, "k", F.col("n")).collect()] == [("a", [1, 2])]


def test_ids_names_and_states(spark):
    rows = spark.createDataFrame([(1, "Ö b"), (2, "ö-B"), (3, "!")], "line int, name string")
    assert [r.id for r in naming.new_ids(rows, "name", "line").orderBy("line").collect()] == ["o-b", "o-b-2", "row"]
    ids = lambda names, taken: [r.id for r in naming.new_ids(spark.createDataFrame(list(enumerate(names)), "line int, name string"), ["name"], "line", spark.createDataFrame([(t,) for t in taken], "id string")).orderBy("line").collect()]
    assert ids(["Ö b", "ö-B", "!"], ["o-b-2", ""]) == ["o-b", "o-b-3", "row"]
    assert ids(["Foo"], ["foo", "foo-5"]) == ["foo-2"]
    rng = random.Random(6)
    for _ in range(4):
        names = [rng.choice(["Foo", "Foo 2", "foo-2-2", "Bar", "Bar 3", "(r)", "Baz"]) for _ in range(12)]
        taken = {x for x in ("foo", "foo-3", "bar-2", "row") if rng.random() < 0.5}
        want, used = [], set(taken)
        for n in names:
            base = {"Foo": "foo", "Foo 2": "foo-2", "foo-2-2": "foo-2-2", "Bar": "bar", "Bar 3": "bar-3", "(r)": "row", "Baz": "baz"}[n]
            want.append(next(i for i in itertools.chain([base], (f"{base}-{k}" for k in itertools.count(2))) if i not in used))
            used.add(want[-1])
        assert ids(names, taken) == want
    v = [naming.Variety("x", "one", "frr"), naming.Variety("y", "two", "frr")]
    assert naming.name_columns(v) == ["one", "local", "two", "de", "da"]
    df = spark.createDataFrame([("A (r); B", "L", "", "y"), ("", "", "C", "y"), ("", "", "", None)], "one string, local string, two string, area string")
    got = naming.resolved(df, v).collect()
    assert [r.names for r in got] == [{"x": "A", "y": "L"}, {"y": "C"}, {}] and [r.local_name for r in got] == ["L", "C", ""]
    assert naming.label_chain("x", True, v) == ["name:x", "name:local", "name:y", "name:frr", "name:nds", "name:de", "name:latin", "name"]
    assert naming.label_chain("x", False, [*v, naming.Variety("z", "three", "nds")])[1:4] == ["name:y", "name:frr", "name:local"]
    assert naming.label_chain("local", True, v) == ["name:local", "name:nds", "name:latin", "name", "name:de"]


def test_search_and_stats(spark):
    e = spark.createDataFrame([(1, "Husum Nord"), (2, "Husumer"), (3, "Hasum"), (4, "Nord")], "k int, n string")
    assert [(r.k, r.distance) for r in search.search(e, "k", "n", "husum").orderBy("place").collect()] == [(1, 0.0), (2, 0.5), (3, 1.0)]
    t = stats.crosstab(spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "p string, q string"), "p", "q")
    assert {(r.p, r.q): r.n for r in t.collect()}[("total", "total")] == 3


@pytest.mark.parametrize(
    "pieces,closed,open_",
    [([[1, 2, 3], [5, 4, 3], [5, 1]], 1, 0), ([[1, 2], [3, 4]], 0, 2), ([[1, 2, 1]], 0, 1), ([[1]], 0, 0), ([[1, 2, 3, 1], [9, 8]], 1, 1), ([[2, 1], [2, 3], [3, 1]], 1, 0)],
)
def test_rings(pieces, closed, open_):
    got = geometry.rings(pieces)
    assert (len(got[0]), len(got[1])) == (closed, open_)
    assert all(r[0] == r[-1] for r in got[0])


def test_simplified_keeps_ends_and_corners():
    line = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0)]
    assert geometry.simplified(line, 0.01) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]


def test_assembled_by_relation(spark):
    ways = spark.createDataFrame(pd.DataFrame({"relation_id": [1, 1, 2], "role_place": [1, 0, 0], "nodes": [[3, 4, 1], [1, 2, 3], [7, 8]]}))
    got = sorted((r.relation_id, r.ring, r.closed) for r in geometry.assembled(ways).collect())
    assert got == [(1, [1, 2, 3, 4, 1], True), (2, [7, 8], False)]


def test_kinds_narrow_and_absorb(spark):
    from wayfold.operators.kinds import BY_NAME

    def run(kind, members, how):
        rows = spark.createDataFrame([(members,)], "a array<struct<t:string,id:int,tags:map<string,string>>>")
        return [m.id for m in rows.select(getattr(BY_NAME[kind], how)(F.col("a")).alias("x")).first().x]

    admin, village = {"boundary": "administrative"}, {"place": "village"}
    assert run("settlement", [("r", 1, admin), ("n", 2, village)], "absorb") == [2]
    assert run("settlement", [("r", 1, admin)], "absorb") == [1]
    assert run("harde", [("r", 1, admin), ("n", 2, village)], "absorb") == [1, 2]
    assert run("landscape", [("r", 1, admin), ("w", 2, village)], "absorb") == [1, 2]
    assert run("settlement", [("w", 1, village), ("n", 2, village), ("r", 3, admin)], "canonical") == [1, 2]
    assert run("island", [("w", 1, {"place": "island"}), ("n", 2, {"place": "island"})], "canonical") == [1]
    assert run("water", [("w", 1, {"water": "lake"}), ("r", 2, {"type": "waterway"}), ("w", 3, {"waterway": "river"})], "canonical") == [2]
    assert run("settlement", [("w", 1, {})], "canonical") == [1]


def test_rows_are_put_after_their_kind(spark):
    from wayfold.operators import tuning

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "line int, kind string, v string")
    new = spark.createDataFrame([("b", 1, "n1"), ("b", 2, "n2"), ("q", 3, "n3")], "kind string, seq int, v string")
    assert [r.v for r in tuning.inserted(rows, new).orderBy("line").collect()] == ["x", "y", "n1", "n2", "z", "n3"]


def test_made_points(spark):
    from wayfold.operators import tuning

    df = spark.createDataFrame([("b", "hamlet", {"name:frr": "F"}, {"place": ""}), ("a", "hamlet", {}, {"name": "N"}), ("c", None, {}, None)], "slug string, place string, names map<string,string>, changes map<string,string>")
    got = {r.slug: (r.id, r.t) for r in tuning.made_objects(df, 100).withColumn("t", tuning.point_tags(F.col("place"), F.col("slug"), F.col("names"), F.col("changes"))).collect()}
    assert got == {"a": (101, {"place": "hamlet", "name": "N"}), "b": (102, None), "c": (103, None)}


def test_many_members_are_grouped_as_one_by_one(spark):
    import random
    import time

    from wayfold.operators.clustering import first_fit

    rng = random.Random(4)
    rows = [(0, i, rng.choice("nw"), 8 + rng.random() / 3, 54 + rng.random() / 3, rng.choice([{"place": "village"}, {"waterway": "river"}, {"highway": "path"}, {}, {}])) for i in range(120)]

    def km(a, b):
        p, q = math.radians(a[4]), math.radians(b[4])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    core = lambda r: r[2] == "n" and "place" in r[5]
    far = lambda r: (30 if "waterway" in r[5] else 5 if "highway" in r[5] else 3) if r[2] == "w" else 3
    want = []
    for r in rows:
        home = next((g for g in want if any(km(r, m) <= (1 if core(r) and core(m) else max(far(r), far(m))) for m in g)), None)
        home.append(r) if home else want.append([r])
    df = spark.createDataFrame(rows, "g int, id int, t string, lon double, lat double, tags map<string,string>")
    got = clustering.clusters(df, ["g"], ["id"]).orderBy("cluster").collect()
    assert [[m.id for m in r.members] for r in got] == [[m[1] for m in g] for g in want]
    # A long list takes a moment, not minutes.
    lon, lat = (np.random.default_rng(1).uniform(a, a + 1, 8000) for a in (8, 54))
    start = time.process_time()
    assert len(first_fit(lon, lat, np.zeros(8000, bool), np.full(8000, np.nan))) == 8000 and time.process_time() - start < 10


def test_what_is_near_is_what_each_pair_says(spark):
    from wayfold.operators.clustering import any_near

    rng = np.random.default_rng(5)
    places = lambda n, span: [8 + span * rng.random(n), 54 + span * rng.random(n), rng.random(n) < 0.5, rng.choice([np.nan, 5.0, 30.0], n, p=[0.8, 0.15, 0.05])]
    mine, others = places(300, 3), places(40, 3)
    mine[0][:3], others[1][:2] = np.nan, np.nan
    p, q = np.radians(mine[1])[:, None], np.radians(others[1])[None]
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(others[0][None] - mine[0][:, None]) / 2) ** 2
    far = np.maximum(np.nan_to_num(mine[3], nan=3)[:, None], np.nan_to_num(others[3], nan=3)[None])
    want = (12742 * np.arcsin(np.sqrt(h)) <= np.where(mine[2][:, None] & others[2][None], 1, far)).any(axis=1)
    assert 10 < want.sum() < 290 and (any_near(mine, others) == want).all()
    assert any_near(mine, [x[:0] for x in others]).sum() == 0 and len(any_near([x[:0] for x in mine], others)) == 0


def test_grouping_grows_with_members_not_with_pairs():
    import time

    from wayfold.operators.clustering import first_fit

    def took(n):
        lon, lat = (np.random.default_rng(1).uniform(a, a + 1, n) for a in (8, 54))
        start = time.process_time()
        assert len(first_fit(lon, lat, np.zeros(n, bool), np.full(n, np.nan))) == n
        return time.process_time() - start

    # Pairs would be sixteen times as many.
    assert took(60_000) < 9 * max(took(15_000), 0.2)


def test_norm_of_plain_and_other_letters(spark):
    from wayfold.functions.text import norm

    df = spark.createDataFrame([("Sankt Peter-Ording",), ("Ærø  Straße",), ("ÅBENRÅ",), ("Kiel_x",), ("ﬁn é",), (None,)], "s string")
    assert [r[0] for r in df.select(norm("s")).collect()] == ["sankt peter ording", "aeroe strasse", "aabenraa", "kiel x", "fin e", ""]
