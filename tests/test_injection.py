import pytest
from pyspark.sql import functions as F

from wayfold.functions.geo import square_around
from wayfold.streaming import injection as inj

EXTRACT = [
    ("x", 1, "n", 5, 8.0, 54.0, None, {"name": "A", "place": "village"}), ("x", 2, "n", 9, 8.1, 54.1, None, None), ("x", 3, "n", 7, None, None, None, {"name": "C"}),
    ("x", 4, "w", 100, None, None, [5, 9], {"name": "W"}), ("x", 5, "w", 90, None, None, [9, 7], {}), ("x", 6, "r", 3, None, None, None, {"name": "R"}), ("x", 7, "r", 2, None, None, None, {}), ("x", 8, "e", 0, None, None, None, None),
    ("y", 1, "r", 1, None, None, None, {}), ("y", 2, "e", 0, None, None, None, None), ("z", 1, "n", 40, 9.0, 55.0, None, {}), ("z", 2, "e", 0, None, None, None, None), ("open", 1, "n", 1, 9.0, 55.0, None, {}),
]
SOURCES = ("x", "y", "z", "open")


@pytest.fixture(scope="module")
def given(spark):
    points = spark.createDataFrame([(s, k, 8.0 + k, 54.0, {"name": f"P{k}"}) for s in SOURCES for k in (1, 2)], "src string, place int, lon double, lat double, tags map<string,string>")
    squares = spark.createDataFrame([(s, k, 8.5, 54.5, 4.0, {"name": f"S{k}"}) for s in SOURCES for k in (1, 2)], "src string, place int, lon double, lat double, km2 double, tags map<string,string>")
    changes = spark.createDataFrame([("n", 5, {"name:frr": "Aa", "place": ""}), ("n", 9, {"name": "B"}), ("r", 3, {"name": ""})], "t string, id long, changes map<string,string>")
    return points, squares, changes


def key(r):
    return r.src, r.seq, r.part, r.t, r.id, r.lon, r.lat, tuple(r.nodes or ()), tuple(sorted((r.tags or {}).items()))


def whole(spark, given):
    return sorted(map(key, inj.injected(spark.createDataFrame(EXTRACT, inj.ROWS), *given).collect()), key=str)


def test_made_objects_come_before_what_they_belong_before(spark, given):
    rows = sorted(inj.injected(spark.createDataFrame(EXTRACT, inj.ROWS), *given).collect(), key=lambda r: (r.src, r.seq, r.part))
    order = {s: [f"{r.t}{r.id}" for r in rows if r.src == s] for s in SOURCES}
    made = [f"n{9 + k}" for k in range(1, 11)]
    assert order["x"] == ["n5", "n9", "n7", *made, "w100", "w90", "w101", "w102", "r3", "r2"]
    assert order["y"] == [*(f"n{k}" for k in range(1, 11)), "w1", "w2", "r1"]
    assert order["z"] == ["n40", *(f"n{40 + k}" for k in range(1, 11)), "w1", "w2"] and order["open"] == ["n1"]
    of = {f"{r.t}{r.id}": r for r in rows if r.src == "x"}
    assert of["w101"].nodes == [12, 13, 14, 15, 12] and of["w102"].nodes == [16, 17, 18, 19, 16] and of["w101"].tags == {"name": "S1"}
    assert of["n5"].tags == {"name": "A", "name:frr": "Aa"} and of["n9"].tags == {"name": "B"} and of["r3"].tags == {} and of["n10"].tags == {"name": "P1"} and of["n12"].tags is None
    ring = spark.range(1).select(square_around(F.lit(8.5), F.lit(54.5), F.lit(4.0)).alias("r")).first().r
    assert [(of[f"n{12 + k}"].lon, of[f"n{12 + k}"].lat) for k in range(4)] == [(p.lon, p.lat) for p in ring]


def files(spark, path, cuts):
    """The extract in files, each written after the one before."""
    rows = sorted(EXTRACT, key=lambda r: (r[1], r[0]))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], inj.ROWS).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5, 8, 11], list(range(1, 13))])
def test_a_stream_equals_the_whole_whatever_the_borders(spark, given, tmp_path, cuts):
    files(spark, f"{tmp_path}/in", cuts)
    inj.inject_stream(inj.extract_stream(spark, f"{tmp_path}/in"), *given, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(key, inj.read_injected(spark, f"{tmp_path}/out").collect()), key=str) == whole(spark, given)


@pytest.mark.parametrize("step", ["made", "state"])
def test_a_restart_from_the_checkpoint_gives_the_same(spark, given, tmp_path, monkeypatch, step):
    """A batch fails before its rows are made, or after they are and before its state is written."""
    files(spark, f"{tmp_path}/in", [2, 5, 9])
    start = lambda: inj.inject_stream(inj.extract_stream(spark, f"{tmp_path}/in"), *given, f"{tmp_path}/out", f"{tmp_path}/check")
    real, calls = inj.advanced, [0]

    def failing(state, rows):
        calls[0] += 1
        if calls[0] == (5 if step == "made" else 6):
            raise RuntimeError("lost")
        return real(state, rows)

    monkeypatch.setattr(inj, "advanced", failing)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    done = {int(p.name.split("=")[1]) for p in (tmp_path / "out" / "out").iterdir() if p.name.startswith("batch=")}
    assert done == ({0, 1} if step == "made" else {0, 1, 2})
    start().awaitTermination()
    assert sorted(map(key, inj.read_injected(spark, f"{tmp_path}/out").collect()), key=str) == whole(spark, given)


def test_later_files_go_on_from_the_state(spark, given, tmp_path):
    files(spark, f"{tmp_path}/in", [])
    start = lambda: inj.inject_stream(inj.extract_stream(spark, f"{tmp_path}/in"), *given, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    start()
    spark.createDataFrame([("open", 2, "w", 8, None, None, [1], {}), ("open", 3, "e", 0, None, None, None, None)], inj.ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    got = sorted((r for r in inj.read_injected(spark, f"{tmp_path}/out").collect() if r.src == "open"), key=lambda r: (r.seq, r.part))
    assert [f"{r.t}{r.id}" for r in got] == ["n1", *(f"n{k}" for k in range(2, 12)), "w8", "w9", "w10"]
