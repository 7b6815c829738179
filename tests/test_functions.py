import hashlib
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, tags, text


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [("Süd-Lügum", "sued luegum"), ("  Højer ", "hoejer"), ("Wyk auf Föhr", "wyk auf foehr"), ("St. Peter’s/Ort", "st peter s ort"), ("ö", "o"), ("a\tb", "ab"), ("É ﬁ Ångström", "e fi aangstroem"), (None, ""), ("!?", ""), ("Nieblum_1", "nieblum 1"), ("ẞ", "ss")],
)
def test_norm(spark, raw, want):
    assert one(spark, text.norm("s"), s=raw) == want


@pytest.mark.parametrize("raw,want", [("Schörkewärw", "schorkewarw"), ("e Strönj", "e-stronj"), ("Ærø ß", "aero-ss"), ("--", ""), (None, "")])
def test_slug_folds_other_letters_than_norm(spark, raw, want):
    assert one(spark, text.slug("s"), s=raw) == want


def python_split(cell):
    out, depth, piece = [], 0, ""
    for ch in cell:
        depth = depth + 1 if ch == "(" else max(0, depth - 1) if ch == ")" else depth
        if ch == ";" and not depth:
            out.append(piece)
            piece = ""
        else:
            piece += ch
    return [*out, piece]


@pytest.mark.parametrize("cell", ["a; b (c; d); e", "", ";", "a)(b;c", "((a;b);c);d", "a(b;c", "x (y) ; z"])
def test_split_variants(spark, cell):
    assert one(spark, text.split_variants("c"), c=cell) == python_split(cell)


def test_cells(spark):
    cell = "Huađer; Huuger (one; two); Third ?; (only)"
    assert one(spark, text.variants("c"), c=cell) == ["Huađer", "Huuger", "Third"]
    assert one(spark, text.primary("c"), c=cell) == "Huađer" and one(spark, text.primary("c"), c="") == ""
    assert one(spark, text.remark("c"), c="A (b) (c)") == "b; c"
    assert one(spark, text.naive_names("c"), c="a (b; c)") == ["a (b", "c)"]
    assert one(spark, text.cell_problem("c"), c="A; B (c)") is None
    parted = "variants are separated by `; ` (no space before, one after)"
    for cell, what in [("A (b", "unbalanced brackets"), ("A (b (c))", "unbalanced or nested brackets"), ("A) b (c", "unbalanced or nested brackets"), ("A;;B", parted), ("A ; B", parted), ("A (b) c", "text after a remark in 'A (b) c'"), ("A  b", "stray spaces in 'A  b'"), ("A?", "`?` in 'A?' -- say `uncertain` in `note` instead"), ("A; B; A", "A twice"), ("A (r; s) (t); B", None), ("", None)]:
        assert one(spark, text.cell_problem("c"), c=cell) == what, cell
    assert [tuple(p) for p in one(spark, text.parts("c"), c="A(x)B ( ) ?; C")] == [("AB", "x"), ("C", "")]


def test_name_values_penalise_derived_ones_once(spark):
    got = [tuple(x) for x in one(spark, text.name_values("v"), v="Insel Kampen (Sylt) / Wyk auf Föhr")]
    assert got[0] == ("Insel Kampen (Sylt) / Wyk auf Föhr", 0)
    assert ("Insel Kampen (Sylt)", 0) in got and ("Insel Kampen", 2) in got and ("Wyk", 2) in got and ("Kampen", 2) not in got


def test_refs(spark):
    refs = text.parse_refs("c")
    assert [tuple(r) for r in one(spark, refs, c="way/12; node/3")] == [("w", 12, None), ("n", 3, None)]
    assert [tuple(r) for r in one(spark, refs, c="local/a-b")] == [("local", None, "a-b")]
    assert one(spark, refs, c="way/12; local/a") is None and one(spark, refs, c="road/1") is None and one(spark, refs, c="way/0") is None
    assert one(spark, text.format_refs(refs), c="relation/9;node/1") == "relation/9; node/1"
    assert tuple(one(spark, text.feature_ref("i"), i=117110961591)) == ("n", 11711096159)
    assert one(spark, text.ref_of_text("c"), c="https://www.openstreetmap.org/Way/12?x=1") == "way/12" and one(spark, text.ref_of_text("c"), c="nothing") is None


def test_small_texts(spark):
    assert one(spark, text.degrees("x"), x=8.5) == "8.5" and one(spark, text.degrees("x"), x=8.0) == "8"
    assert one(spark, text.source_name("p"), p="/data/north-west-250101.osm.pbf") == "north-west" and one(spark, text.source_name("p"), p="x-latest.osm") == "x"
    assert one(spark, text.block_of("c"), c=300) == "256-511"
    blob = "hej ø"
    assert one(spark, text.blob_hash("b"), b=blob) == hashlib.sha1(b"blob %d\0" % len(blob.encode()) + blob.encode()).hexdigest()
    assert one(spark, text.tag_problem("t"), t="frr-x-a") is None and one(spark, text.tag_problem("t"), t="frr-y") and one(spark, text.tag_problem("t"), t="f")
    assert one(spark, text.single_item("t"), t="Q1") == "Q1" and one(spark, text.single_item("t"), t="Q1;Q2") == ""
    assert one(spark, text.regex_escaped("t"), t="a.b(c") == r"a\.b\(c"


def test_decomposition_follows_unicode(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFKD", chr(c))) == 2)
    got = one(spark, text._plain(F.col("s")), s=letters)
    assert got == "".join(c for c in unicodedata.normalize("NFKD", letters) if not unicodedata.combining(c))


def test_distances(spark):
    km = one(spark, geo.haversine("a", "b", "c", "d"), a=8.0, b=54.0, c=9.0, d=54.0)
    assert math.isclose(km, 65.36, abs_tol=0.01)
    assert one(spark, geo.haversine(F.lit(None).cast("double"), "b", "c", "d"), b=54.0, c=9.0, d=54.0) is None
    assert one(spark, geo.km_or(F.lit(0.0), 500)) == 0.0 and one(spark, geo.km_or(F.lit(None).cast("double"), 500)) == 500.0
    assert one(spark, geo.in_box("a", "b"), a=7.8, b=55.12) and not one(spark, geo.in_box("a", F.lit(None).cast("double")), a=8.0)


def obj(t, lon, lat, **tag_map):
    pairs = [F.lit(x) for kv in tag_map.items() for x in kv]
    m = F.create_map(*pairs) if pairs else F.expr("map('x', 'y')")
    return F.struct(F.lit(t).alias("t"), F.lit(lon).cast("double").alias("lon"), F.lit(lat).cast("double").alias("lat"), m.alias("tags"))


@pytest.mark.parametrize(
    "a,b,same",
    [
        (("n", 8.0, 54.5), ("n", 8.0, 54.52), True), (("n", 8.0, 54.5, "village"), ("n", 8.0, 54.52, "village"), False), (("w", 8.0, 54.5, "river"), ("n", 8.0, 54.7), True),
        (("w", 8.0, 54.5, "road"), ("w", 8.0, 54.54), True), (("w", 8.0, 54.5, "road"), ("w", 8.0, 54.56), False), (("n", None, None), ("n", None, None), False),
    ],
)
def test_same_feature_has_reach_by_kind(spark, a, b, same):
    kinds = {"village": {"place": "village"}, "river": {"waterway": "river"}, "road": {"highway": "primary"}}
    x, y = (obj(*o[:3], **kinds.get(o[3], {}) if len(o) > 3 else {}) for o in (a, b))
    assert one(spark, geo.same_feature(x, y)) is same


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_outlines(spark):
    u = ring((0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4))
    for x, y, inside in ((2.0, 2.0, False), (0.5, 2.0, True), (2.0, 0.5, True), (3.0, 2.0, True), (0.0, 0.0, True), (5.0, 0.5, False), (2.0, 1.0, True)):
        assert one(spark, geo.covers(u, F.lit(x), F.lit(y))) is inside, (x, y)
    assert math.isclose(one(spark, geo.ring_km2(geo.square_around(F.lit(8.9), F.lit(54.7), F.lit(4.0)))), 4.0, rel_tol=1e-3)
    assert tuple(one(spark, geo.tile_of(F.lit(8.9), F.lit(54.7), 10))) == (537, 325)
    p = one(spark, geo.tile_point(F.lit(537), F.lit(325), F.lit(0), F.lit(0), 10))
    assert tuple(one(spark, geo.tile_of(F.lit(p.lon + 1e-9), F.lit(p.lat - 1e-9), 10))) == (537, 325)
    circle = one(spark, geo.circle_ring(F.lit(8.9), F.lit(54.7), F.lit(10.0)))
    assert len(circle) == 49 and math.isclose(circle[0].lon, circle[-1].lon)
    assert one(spark, geo.first_position(F.array(F.struct(F.lit(None).cast("double").alias("lon"), F.lit(1.0).alias("lat")), F.struct(F.lit(2.0).alias("lon"), F.lit(3.0).alias("lat"))))).lon == 2.0


def test_tags(spark):
    m = F.create_map(*[F.lit(x) for x in ("name", "", "name:de", "Husum", "natural", "water", "place", "")])
    assert one(spark, tags.name_of(m)) == "Husum" and one(spark, tags.class_of(m)) == "water"
    assert one(spark, tags.decisive(m)) == "place=;natural=water"
    assert one(spark, tags.parse_overrides(F.lit("a=1; b=; a=2"))) == {"a": "2", "b": ""}
    assert one(spark, tags.parse_overrides(F.lit("a"))) is None and one(spark, tags.parse_overrides(F.lit("=1"))) is None and one(spark, tags.parse_overrides(F.lit(None).cast("string"))) == {}
    assert one(spark, tags.overlaid(F.expr("map('a','1','b','2')"), F.expr("map('a','','c','3')"))) == {"b": "2", "c": "3"}
    assert one(spark, tags.filled(F.expr("map('a',' x ','b',' ')"))) == {"a": "x"}
