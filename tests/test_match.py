"""The match plan: a table of cases with every column, the order of candidates, and rows one by one against all at once."""

import pytest

from wayfold.operators import kinds, matching
from wayfold.plans import match as plan
from wayfold.plans import queries as plans

D = "/root/testdata/sf0.001"
OBJECTS = "src string, t string, id long, lon double, lat double, tags map<string,string>"
ROWS = "row_id string, line long, kind string, de string, da string, hint string"


def results(got):
    """Each row's columns as a plain tuple: result, why, refs, wikidata, match_name, match_tags, position, n_candidates."""
    at = lambda r: None if r.lon is None else (round(r.lon, 6), round(r.lat, 6))
    return {r.row_id: (r.result, r.why, [f"{x.t}{x.id}" for x in r.refs], r.wikidata, r.match_name, r.match_tags, at(r), r.n_candidates) for r in got.collect()}


@pytest.fixture(scope="module")
def village(spark):
    """A home village with a boundary of its own item, a namesake far away, a river in pieces, and an island."""
    rows = [
        ("a", "n", 1, 8.9, 54.7, {"name": "Holm", "place": "village"}), ("a", "r", 2, 8.91, 54.7, {"name": "Holm", "boundary": "administrative", "admin_level": "8", "wikidata": "Q2"}),
        ("a", "n", 3, 10.0, 53.6, {"name": "Holm", "place": "hamlet"}), ("a", "w", 4, 8.8, 54.6, {"name": "Au", "waterway": "river"}), ("a", "w", 5, 8.9, 54.6, {"name": "Au", "waterway": "river", "wikidata": "Q5"}),
        ("a", "n", 6, 8.3, 54.9, {"name": "Morsum", "place": "village"}), ("a", "n", 7, 12.0, 50.0, {"name": "Ort", "place": "farm"}), ("a", "n", 8, 9.4, 54.3, {"name": "Ostenfeld (Husum)", "place": "village"}),
        ("a", "n", 9, 9.8, 54.35, {"name": "Ostenfeld", "place": "village"}), ("a", "n", 10, 8.5, 54.6, {"alt_name": "Deich", "name": "Dorf", "place": "village"}), ("a", "w", 11, 8.5, 54.6, {"name": "Deich", "man_made": "dyke"}),
        ("b", "n", 1, 8.9, 54.7, {"name": "Holm", "place": "village", "name:de": "Holm"}), ("a", "n", 12, None, None, {"name": "Lost", "place": "village"}), ("a", "n", 13, 8.6, 54.7, None),
    ]
    return spark.createDataFrame(rows, OBJECTS)


NONE = ([], "", "", "", None)
#: row_id, kind, de, da, hint, and what comes out.
CASES = [
    ("holm", "settlement", "Holm", "", "", ("matched", "auto: only candidate in North Frisia", ["n1"], "Q2", "Holm", "place=village", (8.9, 54.7), 2)),
    ("holm2", "settlement", "Holm", "", "", ("ambiguous", "only match is 142 km from North Frisia (settlement) -- verify by hand", *NONE, 1)),
    ("au", "water", "Au", "", "", ("matched", "", ["w4", "w5"], "Q5", "Au", "waterway=river", (8.9, 54.6), 2)),
    ("au2", "water", "Au", "", "", ("not found", "way/4 is taken by row au; way/5 is taken by row au", *NONE, 0)),
    ("mors", "settlement", "Morsum", "", "Holm", ("ambiguous", "location hint 'Holm' matched no cluster", *NONE, 1)),
    ("ost", "settlement", "Ostenfeld", "", "", None),
    ("none", "settlement", None, None, None, ("not found", "no German/Danish name to match on", *NONE, 0)),
    ("da", "settlement", "", "Dorf", "", ("matched", "", ["n10"], "", "Dorf", "place=village", (8.5, 54.6), 0)),
    ("lost", "settlement", "Lost", "", "", None),
    ("koog", "koog", "Nirgends", "", "", ("not found", "no name match in OSM", *NONE, 0)),
    ("road", "road", "Morsum", "", "", ("not found", "1 name match(es), none compatible with kind=road", *NONE, 1)),
    ("land", "country", "Danmark", "", "", ("matched", "auto: wikidata", [], "Q35", "Danmark", "wikidata", None, 0)),
    ("land2", "country", "Dänemark", "", "", ("not found", "Q35 is taken by row land", *NONE, 0)),
    ("land3", "country", "Xyz", "", "", ("not found", "no Wikidata country item found", *NONE, 0)),
    ("land4", "country", "Ypsilon", "", "", ("lookup failed", "Wikidata lookup failed -- row left unchanged", *NONE, 0)),
    ("odd", "no such kind", "Holm", "", "", None),
]


@pytest.fixture(scope="module")
def decided(spark, village):
    rows = spark.createDataFrame([(r[0], i, *r[1:5]) for i, r in enumerate(CASES)], ROWS)
    # A name with two answers and one with none beside one: the least answer counts, and no row is doubled.
    countries = spark.createDataFrame([("Danmark", "Q35"), ("Danmark", "Q99"), ("Danmark", None), ("Dänemark", "Q35"), ("Xyz", ""), ("Ypsilon", None)], "name string, item string")
    return results(plan.match(rows, village, None, countries))


@pytest.mark.parametrize("case", [c for c in CASES if c[5]], ids=lambda c: c[0])
def test_cases(decided, case):
    assert len(decided) == len(CASES) and decided[case[0]] == case[5]


def test_reasons_that_hold_a_distance(decided):
    assert decided["ost"][1].startswith("best name hit is ") and decided["ost"][0] == "ambiguous"
    assert decided["lost"][0] == "matched" and decided["lost"][6] is None
    assert decided["odd"][0] == "not found" and decided["odd"][1].endswith("none compatible with kind=no such kind")


def test_candidates_keep_the_order_of_records(spark):
    """Nodes come before ways before relations, and sources in the order given: of equals the first counts, of one object the last source."""
    at = (8.9, 54.7)
    objects = spark.createDataFrame([
        ("a", "n", 9, *at, {"name": "Dorp", "place": "village"}), ("a", "w", 5, *at, {"name": "Dorp", "place": "village", "wikidata": "Q5"}), ("a", "r", 2, *at, {"name": "Dorp", "place": "village", "wikidata": "Q2"}),
        ("b", "n", 20, *at, {"name": "Twee", "place": "village", "wikidata": "Q20"}), ("a", "n", 30, *at, {"name": "Twee", "place": "village", "wikidata": "Q30"}),
        ("a", "n", 40, *at, {"name": "Dree", "place": "village", "wikidata": "Qa"}), ("b", "n", 40, *at, {"name": "Dree", "place": "village", "wikidata": "Qb"}),
    ], OBJECTS)
    rows = spark.createDataFrame([(n, i, "settlement", n, "", "") for i, n in enumerate(("Dorp", "Twee", "Dree"))], ROWS)
    given = results(plan.match(rows, objects, sources=("b", "a")))
    assert (given["Dorp"][2], given["Dorp"][3]) == (["n9"], "Q5")
    assert given["Twee"][2] == ["n20"] and given["Dree"][3] == "Qa"
    by_name = results(plan.match(rows, objects))
    assert by_name["Twee"][2] == ["n30"] and by_name["Dree"][3] == "Qb"


def test_rows_at_once_equal_rows_one_by_one(spark, village):
    """Each row alone, with what the rows before it got as claims, comes out as among all."""
    asked = [("a", 1, "settlement", "Holm", "", ""), ("b", 2, "water", "Au", "", ""), ("c", 3, "settlement", "Holm;Dorf", "", ""), ("d", 4, "settlement", "Holm", "", ""), ("e", 5, "settlement", "Dorf", "", "")]
    want, held = {}, []
    for row in asked:
        one = plan.match(spark.createDataFrame([row], ROWS), village, spark.createDataFrame(held, plan.CLAIMS))
        want |= results(one)
        for r in one.where("result = 'matched'").collect():
            held += [(x.t, x.id, None, r.row_id, True) for x in r.refs] + ([(None, None, r.wikidata, r.row_id, True)] if r.wikidata else [])
    assert results(plan.match(spark.createDataFrame(asked, ROWS), village)) == want
    assert len(held) >= 4 and want["d"][0] != "matched"


def test_all_names_of_the_tables_have_one_result_each(spark):
    args = [f(spark, D) for f in (plans._wanted_names, plans._tagged_places, plans._held_claims, plans._countries)]
    got = results(plan.match(*args))
    assert len(got) == args[0].count() and {"matched", "ambiguous", "not found"} <= {r[0] for r in got.values()}
    before = {(c.t, c.id) for c in args[2].collect() if c.t}
    refs = [x for r in got.values() for x in r[2]]
    assert len(refs) == len(set(refs)) and not {(x[0], int(x[1:])) for x in refs} & before
    items = [r[3] for r in got.values() if r[3]]
    assert len(items) == len(set(items)) and not set(items) & {c.item for c in args[2].collect() if c.item}
    for r in got.values():
        assert (r[0] == "matched") == bool(r[2] or r[3]) and (r[0] == "matched" or r[2:7] == NONE)


def test_empty_tables(spark, village):
    rows = spark.createDataFrame([("a", 1, "settlement", "Holm", "", "")], ROWS)
    assert plan.match(rows.limit(0), village).count() == 0
    assert {r[0] for r in results(plan.match(rows, village.limit(0))).values()} == {"not found"}


def test_masks_say_what_the_tests_say(spark):
    """For every kind and many tags, bits and masks give what each kind's own expressions give."""
    from pyspark.sql import functions as F

    values = {"place": ["village", "island", "sea", "locality", "x"], "natural": ["water", "sand", "peninsula"], "boundary": ["administrative", "historic"], "admin_level": ["2", "8", "11", "x"], "waterway": ["river"], "type": ["waterway"], "highway": ["track"], "landuse": ["farmyard"], "man_made": ["dyke"], "water": ["lake"]}
    tags = [{}, None] + [{k: v} for k, vs in values.items() for v in vs] + [{"boundary": "administrative", "admin_level": v} for v in values["admin_level"]] + [{"type": "waterway", "place": "sea"}, {"place": "", "natural": "water"}]
    df = spark.createDataFrame([(t, m) for t in "nwr" for m in tags], "t string, tags map<string,string>").withColumn("o", F.struct("t", "tags"))
    bits, rule = kinds.marks(F.col("o")), lambda k: kinds.rule_of(F.lit(k.name))
    level = lambda k: kinds.at_level(F.col("tags"), rule(k)["levels"])
    for k in kinds.KINDS:
        pairs = [(k.accepts(F.col("o")), kinds.has(bits, rule(k)["accepted"]) | level(k)), (k.covers(F.col("o")), kinds.has(bits, rule(k)["covers"]) | level(k)), (k.bonus(F.col("o")), kinds.points(bits, rule(k)))]
        pairs += [(kinds.passes(F.col("o"), c), kinds.has(bits, rule(k)[f"canon{i}"])) for i, c in enumerate(k.canonic)]
        wrong = F.lit(False)
        for old, new in pairs:
            wrong |= ~old.eqNullSafe(new)
        assert df.where(wrong).count() == 0, k.name


def test_source_order(spark):
    df = spark.createDataFrame([("z",), ("a",), ("m",)], "src string")
    order = lambda *s: [r.src for r in df.orderBy(matching.source_place("src", s)).collect()]
    assert order() == ["a", "m", "z"] and order("z") == ["z", "a", "m"] and order("m", "z", "a") == ["m", "z", "a"]


def test_lines_of_one_row_id_have_a_result_each(spark, village):
    """Lines that repeat a row_id are rows of their own: each comes out once, and the first has what they ask for."""
    asked = [("s", 1, "settlement", "Dorf", "", ""), ("s", 2, "settlement", "Dorf", "", ""), ("s", 3, "road", "Nirgends", "", ""), ("k", 4, "country", "Danmark", "", ""), ("k", 5, "country", "Danmark", "", "")]
    countries = spark.createDataFrame([("Danmark", "Q35")], "name string, item string")
    got = plan.match(spark.createDataFrame(asked, ROWS), village, None, countries).orderBy("line").collect()
    assert [(r.row_id, r.line, r.result, r.why) for r in got] == [
        ("s", 1, "matched", ""), ("s", 2, "not found", "node/10 is taken by row s"), ("s", 3, "not found", "no name match in OSM"),
        ("k", 4, "matched", "auto: wikidata"), ("k", 5, "not found", "Q35 is taken by row k"),
    ]


def test_a_held_part_of_a_winner_and_a_weak_hit_speak_against_it(spark):
    """A member by place that another row holds, and a weaker hit at home that is no member; far ones do not count."""
    river = {"name": "Bek", "waterway": "river"}
    objects = spark.createDataFrame([
        ("a", "w", 1, 8.9, 54.7, river), ("a", "w", 2, 8.95, 54.7, river), ("a", "w", 3, 8.9, 56.0, {**river, "name": "Soel"}), ("a", "w", 4, 8.9, 54.7, {**river, "name": "Soel"}),
        ("a", "n", 5, 12.0, 50.0, {"name": "Ort", "place": "village"}), ("a", "n", 6, 8.9, 54.7, {"name": "X", "name:de": "Ort", "place": "village"}), ("a", "n", 7, 8.9, 54.7, {"name": "Enn", "name:de": "Enn", "place": "village"}),
    ], OBJECTS)
    held = spark.createDataFrame([("w", 2, None, "x", False), ("w", 3, None, "y", False)], plan.CLAIMS)
    rows = spark.createDataFrame([(n, i, k, n, "", "") for i, (n, k) in enumerate((("Bek", "water"), ("Soel", "water"), ("Ort", "settlement"), ("Enn", "settlement")))], ROWS)
    got = results(plan.match(rows, objects, held))
    assert got["Bek"][:2] == ("not found", "way/2 is taken by row x") and got["Soel"][0] == "matched" and got["Enn"][0] == "matched"
    assert got["Ort"][0] == "ambiguous" and got["Ort"][1].endswith("a weaker one lies inside -- verify by hand")
