"""The name list: rules of its rows, what rows hold and show, and the objects that places stand for.

A row has line, id, kind, name columns (one for each variety, ``local``, ``de``, ``da``), hint,
osm, wikidata, status and note, all text but the line. Null cells count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tags, text
from ..functions.text import present, primary, remark
from ..sources.tables import cut
from . import kinds, naming
from .checks import problems
from .matching import ref_text
from .naming import Variety

# Statuses of a row, and what they mean to a run.
STATUSES = ("", "auto", "ok", "skip")
OWNED_STATES = ("auto", "open")
LANGUAGES = ("frr", "nds")
NOT_LOCATED, IN_NO_EXTRACT = "is not located yet", "is in none of the extracts"


def cell(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# Rules.


def header_problems(columns: list[str], required: list[str]) -> list[str]:
    """What is wrong with a header: one column split by semicolons, columns twice, columns that are missing."""
    if len(columns) == 1 and ";" in columns[0]:
        return ["columns are separated by semicolons"]
    twice = sorted({c for c in columns if columns.count(c) > 1})
    missing = [c for c in required if c not in columns]
    return [f"repeated columns: {', '.join(twice)}"] * bool(twice) + [f"missing columns: {', '.join(missing)}"] * bool(missing)


def with_added_columns(rows: DataFrame, layout: list[str]) -> DataFrame:
    """Rows with the columns of the layout they lack, empty, each in its place; columns of their own stay behind those."""
    own = [c for c in rows.columns if c not in layout]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in layout], *own)


def row_rules(refs: Column | None = None) -> list[tuple[Column, Column]]:
    """The rules of one row, in order: kind, status, references (parsed already, if given), item, and no item beside a local reference."""
    kind, status, item, refs = cell("kind"), cell("status"), cell("wikidata"), text.parse_refs("osm") if refs is None else refs
    local = F.coalesce(text.local_of(refs).isNotNull(), F.lit(False))
    quoted = lambda what, c, more="": F.concat(F.lit(f"{what} '"), c, F.lit(f"'{more}"))
    return [
        (~kind.isin(*kinds.BY_NAME), quoted("unknown kind", kind)), (~status.isin(*STATUSES), quoted("unknown status", status, " (auto / ok / skip / empty)")), (refs.isNull(), quoted("bad reference", cell("osm"))),
        ((item != "") & ~item.rlike("^Q[1-9][0-9]*$"), quoted("bad wikidata id", item)), ((item != "") & local, F.lit("a local reference is for a place OSM does not have -- it cannot have a wikidata id")),
    ]


def row_problems(rows: DataFrame, refs: Column | None = None) -> DataFrame:
    """Rows (line, seq, message) for each rule that a row of the list breaks."""
    each = F.array(*[F.when(test, F.struct(F.lit(i).alias("seq"), what.alias("message"))) for i, (test, what) in enumerate(row_rules(refs))])
    return rows.select("line", F.explode(F.filter(each, lambda p: p.isNotNull())).alias("p")).select("line", "p.seq", "p.message")


def by_line(found: DataFrame) -> DataFrame:
    """Problems in order of line, those of one line as they were found."""
    return found.orderBy("line", "seq")


def cell_problems(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (line, column, message) of name cells that are not written as they should be."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    filled = rows.select("line", F.explode(each).alias("p")).select("line", "p.column", "p.value").where("value <> ''")
    return filled.select("line", "column", F.explode(F.array_compact(F.array(text.cell_problem("value")))).alias("message"))


def registry_problems(rows: DataFrame, language: str = "frr") -> DataFrame:
    """The first rule that each row of the registry (line, tag, language, column, label, status, view) breaks, as (line, message).

    Rows without a tag are spacers and left out.
    """
    tag, lang, column = cell("tag"), cell("language"), cell("column")
    above = lambda c: F.min("line").over(Window.partitionBy(c)) < F.col("line")
    marked = rows.where(tag != "").withColumns({"__tag": above("tag"), "__column": above("column")})
    of_tag = F.regexp_extract(tag, "^([a-z]{2,3})(-x(-[a-z0-9]{1,8})+)?$", 1)
    rules = [
        (~lang.rlike("^[a-z]{2,3}$"), "bad language"), (of_tag == "", "bad tag"), (of_tag != lang, "tag of another language"), ((lang == language) & (tag == lang), "no variety in the tag"), (~column.rlike("^[a-z][a-z0-9_]*$"), "bad column name"),
        (column == "local", "a reserved column"), (F.col("__tag") | F.col("__column"), "duplicate tag or column"), (~cell("status").isin("living", "extinct"), "bad status"),
        (~cell("view").isin("yes", "no"), "bad view"), ((cell("view") == "yes") & (lang != language), "a view of another language"), (cell("label") == "", "no label"),
    ]
    return problems(marked, "line", rules, first_only=True)


def area_rows(rows: DataFrame, varieties: list[str]) -> DataFrame:
    """Rows (line, dialect, name, refs, problem) of the area list: the first rule each breaks, null for none.

    Areas are ways or relations of a known variety. A reference belongs to the first good
    row that has it; spacers without variety and reference are left out.
    """
    listed = rows.where((cell("dialect") != "") | (cell("osm") != "")).withColumn("refs", text.parse_refs("osm"))
    odd = F.filter("refs", lambda r: ~r["t"].isin("w", "r"))
    own = F.when(~cell("dialect").isin(*varieties), F.concat(F.lit("unknown dialect '"), cell("dialect"), F.lit("'"))).when(F.col("refs").isNull(), "bad reference").when(F.size("refs") == 0, "no OSM reference")
    own = own.when(F.size(odd) > 0, F.concat(text.format_refs(odd), F.lit(": only way/ or relation/ references are allowed here")))
    marked = listed.withColumn("own", own)
    each = cut(marked.where("own IS NULL").select("line", F.posexplode("refs").alias("at", "r")).select("line", "at", ref_text("r.t", "r.id").alias("ref")), "area-refs")
    good = _first_holders(each)
    held = each.join(good, "line", "left_semi").select("ref", F.col("line").alias("first"))
    taken = each.join(held, "ref").where("first < line").groupBy("line").agg(F.min(F.struct("at", "ref", "first")).alias("f")).select("line", F.concat("f.ref", F.lit(" is already on line "), F.col("f.first").cast("string")).alias("taken"))
    out = marked.join(taken, "line", "left")
    return out.select("line", cell("dialect").alias("dialect"), cell("name").alias("name"), "refs", F.coalesce("own", "taken").alias("problem"))


def _first_holders(each: DataFrame) -> DataFrame:
    """Lines of rows (line, ref) that take all their references, in order of line: none if an earlier such row has one of them.

    Each round settles the rows that are first in all their references and those that
    they shut out; rounds are as many as the longest chain of rows that do so.
    """
    waiting, good = each.select("line", "ref"), None
    while waiting.limit(1).count():
        first = F.min("line").over(Window.partitionBy("ref")) == F.col("line")
        now = cut(waiting.withColumn("first", first).groupBy("line").agg(F.bool_and("first").alias("first")).where("first").select("line"), "area-rows")
        shut = waiting.join(waiting.join(now, "line", "left_semi").select("ref"), "ref", "left_semi").select("line").distinct()
        good = now if good is None else good.unionByName(now)
        waiting = cut(waiting.join(shut, "line", "left_anti"), "area-waiting")
    return each.select("line").limit(0) if good is None else good


# What rows hold.


def claims(refs: Column | None = None) -> Column:
    """struct(refs, item) of what a row holds: nothing for a skipped one."""
    refs = text.parse_refs("osm") if refs is None else refs
    skip = cell("status") == "skip"
    return F.struct(F.when(skip, F.slice(refs, 1, 0)).otherwise(F.coalesce(refs, F.slice(refs, 1, 0))).alias("refs"), F.when(skip, "").otherwise(cell("wikidata")).alias("item"))


def claim_keys(held: Column) -> Column:
    """Each claim as the list spells it: ``way/1``, ``Q35``."""
    spelt = F.transform(held["refs"], lambda r: text.format_refs(F.array(r)))
    return F.concat(F.coalesce(spelt, F.array().cast("array<string>")), F.when(held["item"] != "", F.array(held["item"])).otherwise(F.array().cast("array<string>")))


def standing(rows: DataFrame) -> DataFrame:
    """Rows (line, key, holder) of each row's claims that other rows hold as well: the first line of those."""
    each = rows.select("line", F.explode(F.array_distinct(claim_keys(claims()))).alias("key"))
    w = Window.partitionBy("key")
    first, second = F.min("line").over(w), F.min(F.when(F.col("line") > F.col("first"), F.col("line"))).over(w)
    both = each.withColumn("first", first).withColumn("second", second)
    return both.withColumn("holder", F.when(F.col("line") == F.col("first"), F.col("second")).otherwise(F.col("first"))).where("holder IS NOT NULL").select("line", "key", "holder")


def reference(how: str, refs: Column | None = None, item: Column | None = None) -> Column:
    """struct(osm, wikidata, status), the three cells that are written as one: auto, checked, local, skipped or cleared."""
    osm = F.lit("") if refs is None else text.format_refs(refs)
    item = F.lit("") if item is None or how == "local" else F.coalesce(item, F.lit(""))
    status = {"auto": "auto", "checked": "ok", "local": "ok", "skipped": "skip", "cleared": ""}[how]
    empty = how in ("skipped", "cleared")
    return F.struct((F.lit("") if empty else osm).alias("osm"), (F.lit("") if empty else item).alias("wikidata"), F.lit(status).alias("status"))


def on_map(varieties: list[Variety]) -> Column:
    """Whether a row puts names on the map: it holds something, is a place and has a name in a variety."""
    held = claims()
    holds = (F.coalesce(F.size(held["refs"]), F.lit(0)) > 0) | (held["item"] != "")
    return holds & (cell("kind") != "not_a_place") & (any_name(varieties) != "")


def any_name(varieties: list[Variety], language: str = "frr") -> Column:
    """The first name in a variety of the language: the first of the registry, local, then the others."""
    own = [v.column for v in varieties if v.language == language]
    return naming.any_name([own[0], "local", *own[1:]] if own else ["local"])


def all_name_columns(varieties: list[Variety], language: str = "frr") -> list[str]:
    """Columns of the language, German, those of other languages, Danish."""
    own = [v.column for v in varieties if v.language == language]
    return [*own[:1], "local", *own[1:], "de", *[v.column for v in varieties if v.language != language], "da"]


def state(varieties: list[Variety]) -> Column:
    """The state of a row."""
    refs = text.parse_refs("osm")
    refers = (cell("osm") != "") | (cell("wikidata") != "")
    return naming.row_state(cell("kind"), cell("status"), any_name(varieties) != "", F.coalesce(text.local_of(refs).isNotNull(), F.lit(False)), refers)


def is_owned(state_: Column) -> Column:
    """Whether a run may write a row of the state."""
    return state_.isin(*OWNED_STATES)


def owner_problem(state_: Column) -> Column:
    """Why a decision about a row of the state is refused, null if it is not."""
    dash = lambda c, none: F.coalesce(present(c), F.lit(none))
    said = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is not the matcher's to fill ("), state_, F.lit(": status="), dash("status", "empty"), F.lit(", osm="), dash("osm", "-"), F.lit(")"))
    return F.when(~is_owned(state_), said)


def point_name(varieties: list[Variety]) -> Column:
    """The generic name of a point of our own: German, else Danish, else any variety's."""
    return F.coalesce(present(primary("de")), present(primary("da")), any_name(varieties))


def labelled(name: Column) -> Column:
    """A name with the row's hint in brackets."""
    return F.when(cell("hint") != "", F.concat(name, F.lit(" ("), cell("hint"), F.lit(")"))).otherwise(name)


def name_cells(columns: list[str]) -> Column:
    """The name cells that are not empty, as a map by column."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), cell(c).alias("v")) for c in columns]), lambda e: e["v"] != ""))


# Objects.


def object_facts(tag_map: Column) -> Column:
    """struct(admin_level, name_nds, name, name_frr): what else is known of an object, null for nothing."""
    level = F.when(tags.tag(tag_map, "boundary", "administrative") & tag_map["admin_level"].rlike("^[0-9]+$"), tag_map["admin_level"].try_cast("int"))
    return F.struct(level.alias("admin_level"), *[present(tag_map[k]).alias(k.replace(":", "_")) for k in ("name:nds", "name", "name:frr")])


def named_refs(rows: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (t, id, at, row_id, line) of the object references of rows on the map; ``at`` is the place in the cell."""
    each = rows.where(on_map(varieties)).select(F.col("id").alias("row_id"), "line", F.posexplode(text.parse_refs("osm")).alias("at", "r")).where("r.t <> 'local'")
    return each.select("r.t", "r.id", "at", "row_id", "line")


def unlocated(rows: DataFrame, objects: DataFrame, asked: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (row_id, line, ref, why) of named references without an object; ``asked`` (t, id) were looked for in vain."""
    wanted = named_refs(rows, varieties).groupBy("t", "id").agg(F.max(F.struct("line", "row_id")).alias("r"))
    gone = wanted.join(objects.select("t", "id"), ["t", "id"], "left_anti").join(asked.select("t", "id", F.lit(True).alias("__asked")).distinct(), ["t", "id"], "left")
    return gone.select("r.row_id", "r.line", ref_text("t", "id").alias("ref"), F.when(F.col("__asked"), IN_NO_EXTRACT).otherwise(NOT_LOCATED).alias("why"))


def require_located(found: DataFrame) -> None:
    """Stop if there is any unlocated reference; the message tells the first hundred and how many there are."""
    first = found.orderBy("line", "ref").limit(100).collect()
    if first:
        lines = "\n".join(f"  {r.row_id} (line {r.line}): {r.ref} {r.why}" for r in first)
        raise ValueError(f"{found.count()} object(s) of the name list are not located:\n{lines}")


def located(rows: DataFrame, objects: DataFrame, positions: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (row_id, lon, lat, lon2, lat2, name, name_nds, name_frr, admin_level, problem) of what each row stands for.

    That is the object (t, id, lon, lat, lon2, lat2, facts) of its first reference, moved to
    its position (ref, lon, lat) without an outline point if it has one, or for a local
    reference the point at its position, with the row's own name. A row of an item alone
    has no place; a local reference without a position, or a lost object, is a problem.
    """
    refs = text.parse_refs("osm")
    first = F.get(refs, F.lit(0))
    asked = rows.select(F.col("id").alias("row_id"), first.alias("r"), text.format_refs(F.slice(refs, 1, 1)).alias("ref"), point_name(varieties).alias("own"))
    o = objects.select("t", "id", F.struct("lon", "lat", "lon2", "lat2", "facts").alias("o"))
    out = asked.join(o, (F.col("r.t") == F.col("t")) & (F.col("r.id") == F.col("id")), "left").join(positions.select("ref", F.struct("lon", "lat").alias("p")), "ref", "left")
    local, moved = F.coalesce(F.col("r.t") == "local", F.lit(False)), F.col("p").isNotNull()
    problem = F.when(F.col("r").isNull(), None).when(local & ~moved, F.concat("ref", F.lit(" has no position"))).when(~local & F.col("o").isNull(), F.concat("ref", F.lit(" has no object")))
    fact = lambda c: F.when(~local, F.col("o.facts")[c])
    there = local | F.col("o").isNotNull()
    return out.select(
        "row_id", *[F.when(there & moved, F.col(f"p.{c}")).when(~local, F.col(f"o.{c}")).alias(c) for c in ("lon", "lat")], *[F.when(~local & ~moved, F.col(f"o.{c}")).alias(c) for c in ("lon2", "lat2")],
        F.when(local & moved, present("own")).otherwise(fact("name")).alias("name"), *[fact(c).alias(c) for c in ("name_nds", "name_frr", "admin_level")], problem.alias("problem"),
    )


def outline_point(own: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, lon, lat): the label node of an object, else the first node of its first way that is there.

    ``own`` has key, label (node id or null) and outer (way ids in order); null where neither is there.
    """
    spot = nodes.select(F.col("id").alias("node"), "lon", "lat")
    label = own.join(spot.withColumnRenamed("node", "label"), "label").select("key", F.struct("lon", "lat").alias("a"))
    each = own.select("key", F.posexplode("outer").alias("at", "way")).join(ways.select(F.col("id").alias("way"), F.get("nodes", F.lit(0)).alias("node")), "way")
    first = each.groupBy("key").agg(F.min_by("node", "at").alias("node")).join(spot, "node").select("key", F.struct("lon", "lat").alias("b"))
    both = own.select("key").join(label, "key", "left").join(first, "key", "left").withColumn("p", F.coalesce("a", "b"))
    return both.select("key", "p.lon", "p.lat")


# Names.


def dialect_key(tag: Column | str) -> Column:
    return F.concat(F.lit("name:"), F.lit(tag) if isinstance(tag, str) else tag)


# Fields of an entry and the keys under which tiles have them.
TILE_KEYS = {"id": "place:ref", "kind": "place:kind", "name_de": "name:de", "dialect": "place:dialect", "local": naming.LOCAL, "variety": "place:variety"}


def attribute_keys(more: tuple[str, ...] = ("place:minzoom", "place:maxzoom", "place:square")) -> list[str]:
    """Tile keys that are no name in a language."""
    return [k for k in (*TILE_KEYS.values(), *more) if not k.startswith("name:")]


def osm_name(language: Column, name_frr: Column, name_nds: Column) -> Column:
    """The object's own name in a language that objects carry names in, else the empty string."""
    return F.coalesce(F.when(language == "frr", name_frr).when(language == "nds", name_nds), F.lit(""))


def area_language(area: Column, varieties: list[Variety]) -> Column:
    out = F.lit(None).cast("string")
    for v in reversed(varieties):
        out = F.when(area == v.tag, F.lit(v.language)).otherwise(out)
    return out


def resolved(rows: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows with names (map by tag), name_de, dialect, local, variety and local_from_osm, from name cells, ``area`` and the object's name_frr and name_nds.

    A variety that is a language of its own falls back to the object's name in it; the
    local name to the area's variety, then to the object's name in the area's language.
    """
    area = F.col("area")

    def of(v: Variety) -> Column:
        listed = naming.variety_name(v, area)
        return F.coalesce(present(listed), osm_name(F.lit(v.language), F.col("name_frr"), F.col("name_nds"))) if v.tag == v.language else listed

    names = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(v.tag), of(v)) for v in varieties])), lambda k, v: v != "")
    listed, osm = naming.local_name(varieties, area), osm_name(area_language(area, varieties), F.col("name_frr"), F.col("name_nds"))
    return rows.withColumns({
        "names": names, "name_de": primary("de"), "dialect": F.coalesce(area, F.lit("")), "local_name": F.coalesce(present(listed), osm),
        "variety": remark("local"), "local_from_osm": (osm != "") & (listed == ""),
    })


def unclaimed_tags(area: Column, varieties: list[Variety]) -> Column:
    """Tags of an object that no row claims: its own name in the area's language and the area, or none."""
    local = osm_name(area_language(area, varieties), F.col("name_frr"), F.col("name_nds"))
    return F.when(local != "", F.create_map(F.lit(naming.LOCAL), local, F.lit(TILE_KEYS["dialect"]), F.coalesce(area, F.lit("")))).otherwise(F.create_map().cast("map<string,string>"))


def as_tags() -> Column:
    """The tags of a tile feature of a resolved row: its names by key, and its attributes; empty ones are left out."""
    attributes = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.coalesce(F.col("local_name" if f == "local" else f), F.lit(""))) for f, k in TILE_KEYS.items()]))
    return F.map_filter(F.map_concat(F.transform_keys("names", lambda k, v: dialect_key(k)), attributes), lambda k, v: v != "")


def as_entry() -> Column:
    """The search entry of a resolved row as JSON: positions to five decimals, empty optional fields left out."""
    optional = {"local": F.col("local_name"), "dialect": F.col("dialect"), "variety": F.col("variety"), "name_osm": F.col("name"), "name_da": primary("da"), "osm": cell("osm"), "wikidata": cell("wikidata")}
    return F.to_json(F.struct("id", "names", "name_de", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "kind", *[present(v).alias(k) for k, v in optional.items()]))


def names_of_tile(props: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """struct of the fields of a tile's properties: of several keys of one field the first with a value."""
    return F.struct(*[F.coalesce(*[present(props[k]) for k in keys]).alias(field) for field, keys in aliases.items()])


def local_source(local: Column, dialect: Column, names: Column) -> Column:
    """What the local form is called: the area's variety if it is that variety's name, else local."""
    return F.when(F.coalesce(names[dialect] == local, F.lit(False)), dialect).otherwise(F.lit("local"))


def variety_lines(names: Column, tags_: list[str], headline: Column, shown: Column, local: Column) -> Column:
    """Lines (tag, name) of varieties with a name, but the one the headline shows and those equal to the headline or the local form."""
    each = F.array(*[F.struct(F.lit(t).alias("tag"), names[t].alias("name")) for t in tags_])
    return F.filter(each, lambda x: F.coalesce((x["name"] != "") & ~x["tag"].eqNullSafe(shown) & ~x["name"].eqNullSafe(headline) & ~x["name"].eqNullSafe(local), F.lit(False)))


# Lists for people.


def candidate_summary(name: Column, class_: Column, lon: Column, lat: Column) -> Column:
    """struct(name, class, km): a dash for no class, whole kilometres from the centre (half to even), null for an unknown position."""
    return F.struct(name.alias("name"), F.coalesce(present(class_), F.lit("-")).alias("class"), F.bround(geo.from_centre(lon, lat)).cast("int").alias("km"))


def for_review(result: Column) -> Column:
    return result.isin("ambiguous", "not found")


def work_rows(rows: DataFrame, matches: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows to work through, with ``place`` by kind, then line, and ``fate``: kept, or why a match is not: stale (its row is gone) or unowned.

    ``matches`` has row_id, result and why. Kept ones have name, name_de, name_da, names (map of cells) and slug.
    """
    last = matches.where(for_review(F.col("result"))).select("row_id", "result", "why")
    named = any_name(varieties)
    mine = rows.select(
        F.col("id").alias("row_id"), "line", "kind", named.alias("name"), primary("de").alias("name_de"), primary("da").alias("name_da"),
        name_cells(all_name_columns(varieties)).alias("names"), text.slug(F.coalesce(present(primary("de")), named)).alias("slug"), is_owned(state(varieties)).alias("owned"),
    )
    out = last.join(mine, "row_id", "left").withColumn("fate", F.when(F.col("line").isNull(), "stale").when(~F.col("owned"), "unowned").otherwise("kept"))
    place = F.row_number().over(Window.partitionBy("kind", "fate").orderBy("line"))
    return out.withColumn("kind_order", kinds.kind_order(F.col("kind"))).withColumn("place", place).drop("owned")


def work_summary(work: DataFrame) -> DataFrame:
    """One row of counts: kept rows by result, and those left out."""
    n = lambda c: F.count(F.when(c, 1))
    kept = F.col("fate") == "kept"
    return work.agg(n(kept).alias("rows"), n(kept & (F.col("result") == "ambiguous")).alias("ambiguous"), n(kept & (F.col("result") == "not found")).alias("not_found"), n(F.col("fate") == "unowned").alias("unowned"), n(F.col("fate") == "stale").alias("stale"))


def counts_by_variety(entries: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (seq, tag, n): names by variety in the order of the registry, without those that have none."""
    order = F.create_map(*[x for i, v in enumerate(varieties) for x in (F.lit(v.tag), F.lit(i))])
    return entries.select(F.explode(F.map_keys("names")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select(order[F.col("tag")].alias("seq"), "tag", "n")


def counts_by_area(entries: DataFrame) -> DataFrame:
    """Rows (tag, n, place): objects by area, the most common first."""
    counted = entries.where("dialect <> ''").groupBy(F.col("dialect").alias("tag")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "tag")))


def curated(tunings: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (t, id, label, seen) of tuned objects, and whether the extract has them."""
    return tunings.select("t", "id", "label").join(seen.select("t", "id", F.lit(True).alias("seen")).distinct(), ["t", "id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


# Areas and lookups.


def is_municipality_of(tag_map: Column, prefixes: list[str], keys: tuple[str, ...] = ("de:amtlicher_gemeindeschluessel", "de:regionalschluessel")) -> Column:
    """A municipality's boundary (level 8, or 6 for a city of its own) whose official key begins with one of the prefixes."""
    key = tags.first_of(tag_map, keys)
    begins = F.greatest(*[key.startswith(p) for p in prefixes], F.lit(False))
    level = tags.tag(tag_map, "admin_level", "8") | (tags.tag(tag_map, "admin_level", "6") & tags.tag(tag_map, "place", "city"))
    return tags.tag(tag_map, "boundary", "administrative") & level & begins


def unclaimed_relations(relations: DataFrame, claimed: DataFrame, seen: DataFrame, prefixes: list[str]) -> DataFrame:
    """Municipalities (id, tags) that no row claims (t, id) and no earlier extract (id) had."""
    mine = relations.where(is_municipality_of(F.col("tags"), prefixes))
    return mine.join(claimed.where("t = 'r'").select("id"), "id", "left_anti").join(seen.select("id"), "id", "left_anti")


def parts_by_variety(parts: DataFrame, order: list[str]) -> DataFrame:
    """Rows (dialect, place, names): parts grouped by their variety in list order, unknown ones next, unassigned last, members by name.

    Each member list is what one variety holds; varieties are few, so are lists.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("dialect")), F.lit(0)), F.when(F.col("dialect").isNull(), len(order) + 2).otherwise(len(order) + 1))
    grouped = parts.groupBy("dialect").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count("*").alias("n"))
    return grouped.withColumn("rank", rank).select("dialect", "rank", "n", "names")


def entry_lookup(asked: DataFrame, entries: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``asked`` with the ``entry`` (id) that has the key as its id or among its references; a ``#...`` at the key's end counts only if it must."""
    ids = entries.select(F.col("id").alias("k"), F.lit(0).alias("how"), F.col("id").alias("entry"))
    refs = entries.select(F.explode(F.split("osm", "; ?")).alias("k"), F.lit(1).alias("how"), F.col("id").alias("entry")).where("k <> ''")
    known = ids.unionByName(refs).groupBy("k").agg(F.min(F.struct("how", "entry")).alias("e")).select("k", "e.entry")
    bare = F.regexp_replace(key, "#[^#]*$", "")
    out = asked.join(known.withColumnsRenamed({"k": "__k1", "entry": "__e1"}), F.col(key) == F.col("__k1"), "left").join(known.withColumnsRenamed({"k": "__k2", "entry": "__e2"}), bare == F.col("__k2"), "left")
    return out.select(*asked.columns, F.coalesce("__e1", "__e2").alias("entry"))


def first_country(hits: DataFrame, classes: list[str], name: str = "name") -> DataFrame:
    """Rows (name, item) of the first search hit (name, place, item, classes) that is of one of the classes; the empty string for none."""
    good = F.arrays_overlap("classes", F.array(*[F.lit(c) for c in classes]))
    best = hits.groupBy(name).agg(F.min(F.when(good, F.struct("place", "item"))).alias("b"))
    return best.select(name, F.coalesce("b.item", F.lit("")).alias("item"))


def other_references(wanted: DataFrame, located_for: DataFrame, on: list[str]) -> DataFrame:
    """One row (new, gone): references that are wanted and not located for, and the other way round."""
    new = wanted.select(*on).distinct().join(located_for, on, "left_anti").agg(F.count("*").alias("new"))
    gone = located_for.select(*on).distinct().join(wanted, on, "left_anti").agg(F.count("*").alias("gone"))
    return new.withColumn("k", F.lit(0)).join(gone.withColumn("k", F.lit(0)), "k").select("new", "gone")


# Decisions.


def local_decision() -> Column:
    """struct(reference, curation, warning) of a decision that a place is not there: slug, lat, lon, polygon_km2 and note beside the row's cells."""
    ref = F.array(F.struct(F.lit("local").alias("t"), F.lit(None).cast("long").alias("id"), F.col("slug").alias("slug")))
    square = F.col("polygon_km2").isNotNull()
    has_point = kinds.by_kind(F.col("kind"), lambda k: k.point_place is not None, False)
    row = F.struct(
        F.concat(F.lit("local/"), "slug").alias("osm"), text.degrees("lat").alias("lat"), text.degrees("lon").alias("lon"), F.when(square, F.lit("place=island")).otherwise("").alias("set_tags"),
        F.when(square, F.format_string("%s", "polygon_km2")).otherwise("").alias("polygon_km2"), text.strip(F.coalesce("note", F.lit(""))).alias("note"),
    )
    return F.struct(reference("local", ref).alias("reference"), row.alias("curation"), F.when(~square & ~has_point, F.concat(F.lit("kind="), "kind", F.lit(" has no class of its own for a point"))).alias("warning"))


def checked_decision() -> Column:
    return F.struct(reference("checked", text.parse_refs("ref"), F.col("item")).alias("reference"))


def skip_decision() -> Column:
    return F.struct(reference("skipped").alias("reference"))


#: What each action makes of a decision; clear withdraws an earlier one, which reading the log has done.
ACTIONS: dict[str, Callable[[], Column] | None] = {"osm": checked_decision, "local": local_decision, "skip": skip_decision, "clear": None}


def written(action: str = "action") -> Column:
    """The reference that a row gets by its action; null for one that writes nothing."""
    out = F.lit(None).cast("struct<osm:string,wikidata:string,status:string>")
    for name, make in ACTIONS.items():
        if make:
            out = F.when(F.col(action) == name, make()["reference"]).otherwise(out)
    return out


def patch_order(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines of a log with ``row_line``, in order of their rows (0 for none), then of the log."""
    out = lines.join(rows.select("id", F.col("line").alias("row_line")), "id", "left").withColumn("row_line", F.coalesce("row_line", F.lit(0)))
    return out.orderBy("row_line", "line")


def telling_first(found: DataFrame, key: str, message: str = "message", vague: str = "unexpected") -> DataFrame:
    """Of the problems of one thing the most telling: any other before one that only says ``vague``, then by text."""
    order = F.struct(F.col(message).contains(vague).alias("v"), F.col(message).alias("m"))
    return found.groupBy(key).agg(F.min(order).alias("o")).select(key, F.col("o.m").alias(message))


def rounded(c: Column, places: int = 5) -> Column:
    """A struct of a position and a list of two numbers with so many decimals."""
    return F.struct(F.round(c["lon"], places).alias("lon"), F.round(c["lat"], places).alias("lat"), F.transform(c["outline"], lambda x: F.round(x, places)).alias("outline"))


def stamp_json(label: str = "label", digest: str = "digest") -> Column:
    """An aggregate: labels and digests as one JSON object, in order of label; for stamps, of a few dozen entries."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), F.col(digest).alias("v"))))))


def parse_built_from(description: Column) -> Column:
    """The stamp inside a JSON string, as a map; null where there is none."""
    return F.from_json(F.get_json_object(description, "$.built_from"), "map<string,string>")
