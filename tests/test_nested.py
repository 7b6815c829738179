import json
import random
import re

import pytest

from wayfold.operators.nested import shown_keys


def plain(x):
    if isinstance(x, str):
        return re.findall(r"\{([^}]+)\}", x)
    if not isinstance(x, list):
        return []
    if x[:1] == ["get"] and len(x) > 1 and isinstance(x[1], str):
        return [x[1]]
    if x[:1] == ["case"]:
        args = x[1:]
        x = [a for i, a in enumerate(args) if i % 2 == 1 or i == len(args) - 1]
    return [k for y in x for k in plain(y)]


def expression(rng, depth):
    pick = rng.randrange(8)
    if depth == 0 or pick < 2:
        return rng.choice(["{a} {b:c}", "plain", "{x}", 5, None, True, {"k": "{no}"}, "get", "case"])
    if pick < 4:
        return ["get", rng.choice(["name", "name:de", ["get", "deep"], 3])]
    head = {4: ["case"], 5: ["concat"], 6: [], 7: ["coalesce"]}[pick]
    return head + [expression(rng, depth - 1) for _ in range(rng.randrange(6))]


def test_keys_equal_a_plain_walk(spark):
    rng = random.Random(4)
    trees = [expression(rng, rng.randrange(7)) for _ in range(400)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(1000, None), (1001, "no json ["), (1002, "")]
    got = {}
    for r in shown_keys(spark.createDataFrame(rows, "k int, e string"), "k", "e").collect():
        got.setdefault(r.k, []).append(r.field)
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(set(plain(t))) for i, t in enumerate(trees) if plain(t)}


def test_a_tree_that_is_too_deep_is_an_error(spark):
    deep = lambda n: "[" * n + '["get", "k"]' + "]" * n
    assert shown_keys(spark.createDataFrame([(1, deep(90))], "k int, e string"), "k", "e").collect()[0].field == "k"
    with pytest.raises(Exception, match="RECURSION"):
        shown_keys(spark.createDataFrame([(1, deep(120))], "k int, e string"), "k", "e").collect()


def test_no_expressions(spark):
    assert shown_keys(spark.createDataFrame([], "k int, e string"), "k", "e").count() == 0


def test_nodes_are_not_limited_by_the_limit_of_recursive_queries(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        rows = [(k, '["concat", ["get", "a"], "{b}"]') for k in range(30)]
        assert shown_keys(spark.createDataFrame(rows, "k int, e string"), "k", "e").count() == 60
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
