import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.plans import rebuilds
from wayfold.plans.rebuilds import Outputs, Step
from wayfold.plans.views import View
from wayfold.sources.commits import Store
from wayfold.sources.sinks import Conflict


def test_steps_that_cannot_be_ordered_are_refused_before_any_runs(spark):
    ran = []
    step = lambda name, *after: Step(name, lambda: ran.append(name), after)
    with pytest.raises(ValueError, match="wait for each other: .*a.*b"):
        rebuilds.run(spark, [step("x"), step("a", "b"), step("b", "a")])
    with pytest.raises(ValueError, match="no such steps: gone"):
        rebuilds.run(spark, [step("x", "gone")])
    with pytest.raises(ValueError, match="given twice: x"):
        rebuilds.run(spark, [step("x"), step("x")])
    assert ran == [] and rebuilds.run(spark, []) == {}


def test_a_failed_step_blocks_only_what_comes_after_it(spark):
    def fail():
        raise OSError("no disk")

    steps = [
        Step("last", lambda: None, ("second", "free")), Step("first", fail), Step("second", lambda: None, ("first",)),
        Step("free", lambda: ["two refused"]), Step("idle", fail, needed=lambda: None), Step("odd", lambda: None, needed=fail),
    ]
    got = rebuilds.run(spark, steps)
    assert list(got) == [s.name for s in steps]
    assert {n: (o.state, o.said) for n, o in got.items()} == {
        "last": ("blocked", "after second"), "first": ("failed", "OSError: no disk"), "second": ("blocked", "after first"),
        "free": ("warned", "two refused"), "idle": ("current", ""), "odd": ("failed", "OSError: no disk"),
    }


def test_independent_steps_run_at_the_same_time_and_others_in_order(spark):
    meet, order = threading.Barrier(3, timeout=20), []
    together = [Step(n, lambda n=n: (meet.wait(), order.append(n))[1:0] or None) for n in "abc"]
    got = rebuilds.run(spark, [Step("end", lambda: order.append("end"), ("a", "b", "c")), *together])
    assert {o.state for o in got.values()} == {"done"} and order[-1] == "end"


def test_outputs_follow_their_inputs_and_only_those(spark, tmp_path):
    a, b = spark.range(6).select((F.col("id") % 3).alias("k"), "id"), spark.range(4)
    calls = Counter()

    def counted(name, f):
        def make(*tables):
            calls[name] += 1
            return f(*tables)

        return make

    views = [
        View("top", ["sum", "b"], counted("top", lambda s, t: s.crossJoin(t.agg(F.max("id").alias("m"))))), View("sum", ["a"], counted("sum", lambda t: t.groupBy("k").agg(F.sum("id").alias("s")))),
        View("copy", ["b"], counted("copy", lambda t: t), dear=True),
    ]
    store = Store(spark, f"file://{tmp_path}/s")
    states = lambda got: {n: o.state for n, o in got.items()}
    out = Outputs(store, views, {"a": a, "b": b})
    assert out.problems() == {"top": "missing", "sum": "missing", "copy": "missing"}
    assert {(o.state, o.said) for o in out.update().values()} == {("done", "missing")}
    assert sorted(map(tuple, store.read("top").collect())) == [(0, 3, 3), (1, 5, 3), (2, 7, 3)]
    assert states(out.update()) == {"top": "current", "sum": "current", "copy": "current"} and set(calls.values()) == {1}
    # The same rows in another order are no other input; cheap outputs are made again when asked for, dear ones are not.
    again = Outputs(store, views, {"a": a.orderBy(F.desc("id")), "b": b})
    assert states(again.update(everything=True)) == {"top": "done", "sum": "done", "copy": "current"} and again.problems() == {}
    more = Outputs(store, views, {"a": a.union(a), "b": b})
    assert more.problems() == {"sum": "changed: a"}
    got = more.update()
    assert states(got) == {"top": "done", "sum": "done", "copy": "current"} and got["sum"].said == "changed: a" and got["top"].said == "changed: sum"
    assert sorted(map(tuple, store.read("top").collect())) == [(0, 6, 3), (1, 10, 3), (2, 14, 3)]
    with pytest.raises(ValueError, match="given tables: sum"):
        Outputs(store, views, {"a": a, "b": b, "sum": a})


def test_an_output_that_is_not_reproducible_is_named(spark, tmp_path):
    a = spark.range(5)
    views = [
        View("same", ["a"], lambda t: t), View("odd", ["a"], lambda t: t.withColumn("u", F.expr("uuid()"))),
        View("lost", ["a"], lambda t: t.where("id >= 0")), View("late", ["a"], lambda t: t),
    ]
    store = Store(spark, f"file://{tmp_path}/s")
    Outputs(store, views, {"a": a}).update()
    views[2] = View("lost", ["a"], lambda t: t.select("nothing"))
    views[3] = View("late", ["a"], lambda t: t.withColumn("more", F.lit(1)))
    before = store.version().number
    got = Outputs(store, views, {"a": a}).problems()
    assert set(got) == {"odd", "lost", "late"} and store.version().number == before
    assert got["odd"] == "not what its inputs give: 10 rows differ" and got["late"] == "not what its inputs give: other columns"
    assert got["lost"].startswith("cannot be rebuilt: AnalysisException")
    failed = Outputs(store, views, {"a": spark.range(6)}).update()
    assert failed["lost"].state == "failed" and store.read("lost").count() == 5 and store.read("same").count() == 6


def test_row_differences_count_repeats_nulls_and_empty_tables(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "x int, y string")
    got = lambda a, b: sorted(map(tuple, rebuilds.row_differences(a, b).collect()), key=repr)
    a = rows((1, "a"), (1, "a"), (None, None), (2, None))
    assert got(a, a) == [] and got(a, a.select("y", "x")) == []
    assert got(a, rows((1, "a"), (None, None), (2, ""))) == sorted([(1, "a", 2, 1), (2, None, 1, 0), (2, "", 0, 1)], key=repr)
    assert got(rows(), a) == sorted([(1, "a", 0, 2), (None, None, 0, 1), (2, None, 0, 1)], key=repr) and got(rows(), rows()) == []


def test_replace_keeps_what_others_commit_and_refuses_to_overwrite_them(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.replace({"a": spark.range(1)})
    write = store.write

    def meanwhile(table):
        def both(part, rows):
            write(part, rows)
            store.write = write
            store.replace({table: spark.range(7)})

        return both

    store.write = meanwhile("b")
    store.replace({"a": spark.range(2)})
    assert store.read("a").count() == 2 and store.read("b").count() == 7
    store.write = meanwhile("a")
    with pytest.raises(Conflict, match="a changed meanwhile"):
        store.replace({"a": spark.range(3)})
    assert store.read("a").count() == 7 and store.unused() == []
