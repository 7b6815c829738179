"""The flagship plan: names of rows resolved to objects, in the order of the rows.

A pass decides all rows at once, as joins, windows and sums: candidates by name, those that
the row's kind accepts, boundaries set aside, the canonical ones, clusters of the best name
hits, the winner by hint or by its place, the member that suits best to carry the name.

What a row gets is not for a later row to get. A pass decides rows as if none before them got
anything; that stands for the rows of a conflict group (``claims.conflict_groups``) up to the
first whose candidates an earlier row of the group gets. The next pass goes on there, among the
rows that are left, with what is settled as claims. So passes are as many as the longest chain
of rows that take objects from each other, not as many as there are rows. Items decide nothing
about objects: who has an item is settled once, at the end, by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOUNDARY_KM, GERMAN_NAME_POINTS, ITEM_POINTS, KM_PER_POINT, MINOR_PLACE_KM, MINOR_PLACES, SEPARATION_KM, UNPLACED_KM
from ..functions import geo, tags
from ..functions.text import norm, variants
from ..operators import claims, clustering, kinds, listcheck, lookup, matching
from ..sources.tables import cut

FAR = float("inf")
#: What another row holds: an object (t, id) or an item, the row, and whether the run itself gave it out.
CLAIMS = "t string, id long, item string, holder string, given boolean"
RESULT = "row_id string, line long, result string, why string, refs array<struct<t:string,id:bigint>>, wikidata string, match_name string, match_tags string, lon double, lat double, n_candidates long"


def query_names(de: Column | str, da: Column | str) -> Column:
    """The German names of a row; the Danish ones where there is none."""
    german = variants(de)
    return F.when(F.size(german) > 0, german).otherwise(variants(da))


def candidates(rows: DataFrame, objects: DataFrame, index: DataFrame | None = None, sources: tuple[str, ...] = ()) -> DataFrame:
    """Rows (row_id, line, kind, hint, t, id, rank, byname, place, ...): what each row's names find, and what its kind says of it.

    ``rows`` has row_id, line, kind, de, da and hint. ``place`` is the order in which the
    row's names find objects: name by name, source by source (``matching.source_place``),
    nodes before ways before relations, by id. Of an object that several sources have the last one counts.
    ``objects`` may have ``marks`` already.
    """
    if "marks" not in objects.columns:
        objects = objects.withColumn("marks", kinds.marks(F.struct("t", "tags")))
    index = matching.name_index(objects) if index is None else index
    asked = rows.select("row_id", "line", "kind", F.posexplode(query_names("de", "da")).alias("q", "name")).withColumn("key", norm("name")).where("key <> ''")
    hits = asked.join(index, "key").withColumn("of", matching.source_place("src", sources)).groupBy("row_id", "line", "kind", "t", "id").agg(
        F.min("rank").alias("rank"), F.bool_and("byname").alias("byname"), F.min(F.struct("q", "of")).alias("first"), F.max("of").alias("last")
    )
    found = hits.withColumn("src", F.col("last.name")).join(objects.select("src", "t", "id", "lon", "lat", "tags", "marks"), ["src", "t", "id"]).withColumn("rule", kinds.rule_of(F.col("kind")))
    item = F.coalesce(F.col("tags")["wikidata"], F.lit(""))
    km = geo.km_or(geo.from_centre("lon", "lat"), UNPLACED_KM)
    own = F.when(item != "", ITEM_POINTS).otherwise(0) + F.when(tags.tag(F.col("tags"), "name:de"), GERMAN_NAME_POINTS).otherwise(0)
    bits, rule = F.col("marks"), F.col("rule")
    level = kinds.at_level(F.col("tags"), rule["levels"])
    return found.select(
        "row_id", "line", "kind", "t", "id", "rank", "byname", "lon", "lat", F.struct("first.q", F.col("first.of").alias("of"), matching.type_place("t").alias("type"), "id").alias("place"), item.alias("item"),
        (kinds.has(bits, rule["accepted"]) | level).alias("accepted"), (kinds.has(bits, rule["covers"]) | level).alias("covers"), F.coalesce(rule["boundary"], F.lit("feature")).alias("yields"),
        kinds.bare_boundary(F.col("tags")).alias("bare"), ((F.col("t") == "n") & tags.tag(F.col("tags"), "place")).alias("place_node"), kinds.has(bits, rule["canon0"]).alias("canon0"), kinds.has(bits, rule["canon1"]).alias("canon1"),
        tags.tag(F.col("tags"), "place", *MINOR_PLACES).alias("minor"), geo.linear_km(F.col("t"), F.col("tags")).alias("linear"), geo.is_core(F.col("t"), F.col("tags")).alias("core"),
        (kinds.points(bits, rule) + own - km / KM_PER_POINT).alias("score"), geo.admin_level(F.col("tags")).alias("level"),
        tags.name_of(F.col("tags")).alias("name"), norm(F.coalesce(F.col("tags")["name"], F.lit(""))).alias("plain"), tags.decisive(F.col("tags")).alias("says"),
    )


def _tiers(plausible: DataFrame) -> DataFrame:
    """Clusters (row_id, tier, cluster, lon, lat, members) of the best name hits (tier 0) and, where there are weaker ones, of all (tier 1)."""
    both = F.when(F.col("best"), F.when(F.col("n_all") > F.col("n_best"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).otherwise(F.array(F.lit(1)))
    member = F.struct("place", "t", "id", "lon", "lat", "core", "linear", "minor")
    packed = plausible.select("row_id", F.explode(both).alias("tier"), member.alias("m")).groupBy("row_id", "tier").agg(F.array_sort(F.collect_list("m")).alias("all"))
    each = clustering.greedy(packed, ["row_id", "tier"], "all", lambda m: m["core"], lambda m: m["linear"])
    return each.withColumn("c", clustering.centred(F.col("members"))).select("row_id", "tier", "cluster", "members", "c.lon", "c.lat")


def _winners(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """For each row and tier: the winner's cluster (null for none), n clusters and whether the winner is implausible for the row's kind."""
    k = clusters.join(rows.select("row_id", "home_only", "circle"), "row_id")
    near = F.coalesce(geo.haversine("lon", "lat", F.col("circle.lon"), F.col("circle.lat")) <= F.col("circle.km"), F.lit(False))
    minor = F.exists("members", lambda m: m["minor"])
    k = k.select("row_id", "tier", "cluster", "home_only", "lon", "lat", F.col("circle").isNotNull().alias("hinted"), near.alias("near"), geo.in_box("lon", "lat").alias("home"), minor.alias("minor"), geo.from_centre("lon", "lat").alias("km"))
    w = Window.partitionBy("row_id", "tier")
    k = k.withColumn("inside", F.min(F.when(F.col("home"), F.struct("cluster", "lon", "lat"))).over(w))
    close = (F.col("cluster") != F.col("inside.cluster")) & (geo.km_or(geo.haversine("lon", "lat", F.col("inside.lon"), F.col("inside.lat")), FAR) <= SEPARATION_KM)
    k = k.withColumn("close", F.coalesce(close, F.lit(False)))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = k.groupBy("row_id", "tier", "hinted").agg(
        F.count("*").alias("n"), count(F.col("near")).alias("n_near"), F.min(F.when(F.col("near"), F.col("cluster"))).alias("near"), count(F.col("home")).alias("n_home"),
        F.min(F.when(F.col("home"), F.col("cluster"))).alias("home"), F.bool_or("close").alias("close"), F.min("cluster").alias("one"),
    )
    alone = F.when(F.col("n") == 1, F.col("one")).when((F.col("n_home") == 1) & ~F.col("close"), F.col("home"))
    winner = F.when(F.col("hinted"), F.when(F.col("n_near") == 1, F.col("near"))).otherwise(alone)
    reason = F.when(F.col("hinted"), "location hint").when(F.col("n") == 1, "single cluster").otherwise("only candidate in North Frisia")
    got = got.select("row_id", "tier", winner.alias("cluster"), F.col("n").alias("n_clusters"), reason.alias("reason"))
    suspicious = ~F.col("home") & (F.col("home_only") | (F.col("minor") & (geo.km_or(F.col("km"), FAR) > MINOR_PLACE_KM)))
    facts = k.select("row_id", "tier", "cluster", "home", "km", suspicious.alias("suspicious"))
    return got.join(facts, ["row_id", "tier", "cluster"], "left")


def decide(rows: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """One pass: rows (RESULT) for ``rows`` (row_id, line, kind, circle, named, hint) among their ``candidates``, given what others hold."""
    objects = held.where("t IS NOT NULL").groupBy("t", "id").agg(F.min("holder").alias("holder"), F.bool_and("given").alias("given"))
    cands = found.join(rows.select("row_id"), "row_id", "left_semi").join(objects, ["t", "id"], "left")
    by_row = Window.partitionBy("row_id")
    free = F.col("holder").isNull()
    cands = cands.withColumns({"free": free, "plaus": free & F.col("accepted")})
    node = F.max(F.col("plaus") & F.col("place_node")).over(by_row)
    cands = cands.withColumn("node", node).withColumn("aside", F.col("plaus") & F.col("bare") & ((F.col("yields") == "yields") | ((F.col("yields") == "yields to node") & F.col("node"))))
    cands = cands.withColumn("rest", F.max(F.col("plaus") & ~F.col("aside")).over(by_row))
    cands = cands.withColumn("in1", F.col("plaus") & (~F.col("aside") | ~F.col("rest")))
    cands = cands.withColumns({f"any{i}": F.max(F.col("in1") & F.col(f"canon{i}")).over(by_row) for i in (0, 1)})
    cands = cands.withColumn("in2", F.col("in1") & F.when(F.col("any0"), F.col("canon0")).when(F.col("any1"), F.col("canon1")).otherwise(F.lit(True)))
    cands = cands.withColumn("top", F.min(F.when(F.col("in2"), F.col("rank"))).over(by_row)).withColumn("best", F.col("in2") & (F.col("rank") == F.col("top")))
    count = lambda c: F.count(F.when(F.col(c), 1)).over(by_row)
    cands = cut(cands.withColumns({"n_found": F.count("*").over(by_row), "n_free": count("free"), "n_all": count("in2"), "n_best": count("best")}), "match-candidates")
    clusters = cut(_tiers(cands.where("in2")), "match-clusters")
    tiers = _winners(clusters, rows)
    tier = lambda i: tiers.where(F.col("tier") == i).select("row_id", *[F.col(c).alias(f"{c}{i}") for c in ("cluster", "n_clusters", "reason", "home", "km", "suspicious")])
    sizes = cands.groupBy("row_id").agg(*[F.max(c).alias(c) for c in ("n_found", "n_free", "n_all", "n_best")])
    out = rows.join(sizes, "row_id", "left").join(tier(0), "row_id", "left").join(tier(1), "row_id", "left")
    again = F.col("cluster0").isNotNull() & F.col("suspicious0") & F.col("cluster1").isNotNull() & ~F.col("suspicious1")
    out = out.withColumn("tier", F.when(F.coalesce(again, F.lit(False)), 1).otherwise(0))
    pick = lambda c: F.when(F.col("tier") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c)
    out = out.select("row_id", "line", "kind", "hint", "named", "circle", "tier", "n_found", "n_free", "n_all", "n_best", *[pick(c) for c in ("cluster", "n_clusters", "reason", "home", "km", "suspicious")])
    out = cut(out.join(clusters.select("row_id", "tier", "cluster", "members"), ["row_id", "tier", "cluster"], "left"), "match-winners")

    # What speaks against a winner: a weaker hit at home that is no part of it, or a part of it that another row holds.
    # Members are joined by their own keys or looked at once for a row, as a winner may have very many and so may what is held against it.
    inside = out.select("row_id", F.explode("members").alias("m")).select("row_id", "m.t", "m.id")
    weak = cands.where("in2 and not best").where(geo.in_box("lon", "lat")).select("row_id", "t", "id").join(inside, ["row_id", "t", "id"], "left_anti")
    taken = cands.where("holder IS NOT NULL").withColumn("note", F.concat(matching.ref_text("t", "id"), F.lit(" is taken by row "), "holder"))
    note = lambda df: df.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "note"))), lambda x: x["note"]), "; ").alias("note"))
    others = taken.where("covers and not (given and byname)").select("row_id", F.struct("place", "note", "lon", "lat", "core", "linear").alias("o")).groupBy("row_id").agg(F.collect_list("o").alias("others"))
    near = clustering.near("others", "members", lambda m: m["core"], lambda m: m["linear"])
    parts = note(others.join(out.where("members IS NOT NULL").select("row_id", "members"), "row_id").select("row_id", F.explode(near).alias("o")).select("row_id", "o.place", "o.note"))
    out = out.join(weak.select("row_id").distinct().withColumn("weak", F.lit(True)), "row_id", "left").join(parts.withColumnRenamed("note", "held_note"), "row_id", "left").join(note(taken).withColumnRenamed("note", "taken_note"), "row_id", "left")
    none, won = F.coalesce("n_free", F.lit(0)) == 0, F.col("cluster").isNotNull()
    review = F.col("suspicious") | (F.col("circle").isNull() & ~F.col("home") & F.coalesce("weak", F.lit(False)))
    where = F.when(F.col("km").isNull(), "has no known position").otherwise(F.concat(F.lit("is "), F.format_string("%.0f", "km"), F.lit(" km from North Frisia")))
    cases = [
        (~F.col("named"), "not found", F.lit("no German/Danish name to match on")),
        (none, "not found", F.coalesce("taken_note", F.lit("no name match in OSM"))),
        (F.col("n_all") == 0, "not found", F.concat(F.col("n_free").cast("string"), F.lit(" name match(es), none compatible with kind="), "kind")),
        (~won & F.col("circle").isNotNull(), "ambiguous", F.concat(F.lit("location hint '"), "hint", F.lit("' matched no cluster"))),
        (~won, "ambiguous", F.concat(F.col("n_clusters").cast("string"), F.lit(" plausible candidates"))),
        (review & F.col("suspicious"), "ambiguous", F.concat(F.lit("only match "), where, F.lit(" ("), "kind", F.lit(") -- verify by hand"))),
        (review, "ambiguous", F.concat(F.lit("best name hit "), where, F.lit(", a weaker one lies inside -- verify by hand"))),
        (F.col("held_note").isNotNull(), "not found", F.col("held_note")),
    ]
    said = F.concat("reason", F.when(F.col("tier") == 1, " (weaker name hit)").otherwise(""))
    result, why = F.lit("matched"), F.when(said == "single cluster", "").otherwise(F.concat(F.lit("auto: "), said))
    for test, what, text in reversed(cases):
        result, why = F.when(F.coalesce(test, F.lit(False)), what).otherwise(result), F.when(F.coalesce(test, F.lit(False)), text).otherwise(why)
    out = out.withColumns({"result": result, "why": why})
    shown = F.when(F.col("result") == "matched", F.when((F.size("members") > 1) | (F.col("n_clusters") > 1), F.when(F.col("tier") == 1, F.col("n_all")).otherwise(F.col("n_best"))).otherwise(0))
    shown = F.coalesce(shown, F.when(~F.col("named") | none, 0).when(F.col("n_all") == 0, F.col("n_free")).otherwise(F.col("n_all")))
    out = cut(out.select("row_id", "line", "result", "why", "members", shown.cast("long").alias("n_candidates")), "match-decisions")
    return _whole(out.drop("members").join(_carriers(out.where("result = 'matched'"), cands), "row_id", "left"))


def _carriers(won: DataFrame, cands: DataFrame) -> DataFrame:
    """Rows (row_id, refs, wikidata, match_name, match_tags, lon, lat) of winners: the member that carries the name, and its item."""
    fields = ("t", "id", "lon", "lat", "score", "item", "linear", "plain", "name", "says", "place")
    members = won.select("row_id", F.explode("members").alias("m")).select("row_id", "m.t", "m.id").join(cands.select("row_id", *fields), ["row_id", "t", "id"])
    # The best score; of equals the first found.
    best = members.withColumn("n", F.row_number().over(Window.partitionBy("row_id").orderBy(F.col("score").desc(), "place"))).where("n = 1").select("row_id", F.struct(*fields).alias("b"))
    with_best = members.join(best, "row_id")
    piece = F.col("linear").isNotNull() & (F.col("t") == F.col("b.t")) & (F.col("plain") == F.col("b.plain"))
    of = with_best.groupBy("row_id", "b").agg(F.collect_set(F.when(piece, F.col("id"))).alias("pieces"), F.min(F.when(F.col("item") != "", F.struct("place", "item"))).alias("sibling"))
    aside = cands.where("aside and item <> ''").select("row_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "level", F.col("item").alias("its"))
    near = aside.join(best, "row_id").withColumn("km", geo.haversine(F.col("b.lon"), F.col("b.lat"), "lon2", "lat2")).where(F.col("km") <= BOUNDARY_KM)
    near = near.groupBy("row_id").agg(F.min(F.struct((-F.col("level")).alias("l"), "km", "its")).alias("boundary"))
    refs = F.when(F.col("b.linear").isNull(), F.array("b.id")).otherwise(F.array_sort("pieces"))
    item = F.coalesce(F.nullif("b.item", F.lit("")), F.col("sibling.item"), F.col("boundary.its"), F.lit(""))
    both = of.join(near, "row_id", "left")
    placed = F.col("b.lon").isNotNull() & F.col("b.lat").isNotNull()
    return both.select(
        "row_id", F.transform(refs, lambda i: F.struct(F.col("b.t").alias("t"), i.alias("id"))).alias("refs"), item.alias("wikidata"), F.col("b.name").alias("match_name"), F.col("b.says").alias("match_tags"),
        *[F.when(placed, F.col(f"b.{c}")).alias(c) for c in ("lon", "lat")],
    )


def _whole(results: DataFrame) -> DataFrame:
    """Results with all columns of RESULT, empty where there is nothing."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return results.select("row_id", "line", "result", "why", F.coalesce("refs", F.array().cast("array<struct<t:string,id:bigint>>")).alias("refs"), text("wikidata"), text("match_name"), text("match_tags"), "lon", "lat", "n_candidates")


def without_taken_items(results: DataFrame, held: DataFrame) -> DataFrame:
    """Results (RESULT) without items that others hold: whoever held one before, else the first matched row that has it.

    A row matched by its item alone is then not found and has nothing but the reason.
    """
    before = held.where("item <> ''").groupBy(F.col("item").alias("wikidata")).agg(F.min("holder").alias("before"))
    has = (F.col("result") == "matched") & (F.col("wikidata") != "")
    first = results.where(has).groupBy("wikidata").agg(F.min(F.struct("line", "row_id")).alias("first"))
    out = results.join(before, "wikidata", "left").join(first, "wikidata", "left")
    holder = F.coalesce("before", F.when(F.col("first.line") != F.col("line"), F.col("first.row_id")))
    lost, bare = has & holder.isNotNull(), F.size("refs") == 0
    note = F.concat("wikidata", F.lit(" is taken by row "), holder)
    why = F.when(lost & ~bare, F.concat_ws("; ", F.nullif("why", F.lit("")), note)).when(lost, note).otherwise(F.col("why"))
    empty = lambda c, v: F.when(lost & bare, F.lit(v)).otherwise(F.col(c))
    gone = {c: empty(c, v) for c, v in (("match_name", ""), ("match_tags", ""), ("lon", None), ("lat", None), ("n_candidates", 0), ("result", "not found"))}
    return _whole(out.withColumns({**gone, "why": why, "wikidata": F.when(lost, "").otherwise(F.col("wikidata"))}))


def match_countries(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (RESULT) of rows found by their item: ``items`` has name and item, empty for a name that is no country's, null for no answer.

    Of several items of one name the least that is an answer counts.
    """
    once = items.groupBy("name").agg(F.min("item").alias("item"), F.lit(True).alias("asked"))
    asked = rows.withColumn("name", F.coalesce(F.get(variants("de"), F.lit(0)), F.lit(""))).join(once, "name", "left")
    failed, none = F.col("asked") & F.col("item").isNull(), F.coalesce("item", F.lit("")) == ""
    result = F.when(failed, "lookup failed").when(none, "not found").otherwise("matched")
    why = F.when(failed, "Wikidata lookup failed -- row left unchanged").when(none, "no Wikidata country item found").otherwise("auto: wikidata")
    return asked.select(
        "row_id", "line", result.alias("result"), why.alias("why"), F.array().cast("array<struct<t:string,id:bigint>>").alias("refs"), F.coalesce("item", F.lit("")).alias("wikidata"),
        F.when(none, "").otherwise(F.col("name")).alias("match_name"), F.when(none, "").otherwise(F.lit("wikidata")).alias("match_tags"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(0).cast("long").alias("n_candidates"),
    )


def match(rows: DataFrame, objects: DataFrame, held: DataFrame | None = None, countries: DataFrame | None = None, sources: tuple[str, ...] = ()) -> DataFrame:
    """Rows (RESULT) for rows (row_id, line, kind, de, da, hint), distinct in line, and objects (src, t, id, lon, lat, tags).

    A row_id that several lines have makes a row of each: rows are told apart by line and row_id.

    ``held`` (CLAIMS) is what other rows hold and ``countries`` (name, item) the items of
    rows that are found by item. ``sources`` gives the order of sources. Empty tables give an empty result; null cells count as
    empty; a row of an unknown kind accepts nothing.
    """
    spark = rows.sparkSession
    held = spark.createDataFrame([], CLAIMS) if held is None else held.select("t", "id", "item", "holder", "given")
    countries = spark.createDataFrame([], "name string, item string") if countries is None else countries
    rule = kinds.rule_of(F.col("kind"))
    of_kind = {c: F.coalesce(rule[c], F.lit(False)) for c in ("by_item", "home_only")}
    rows = cut(rows.withColumn("name_id", F.col("row_id")).withColumn("row_id", F.concat_ws("/", "line", "row_id")), "match-list")
    objects = listcheck.dealt(objects, "match-objects", kinds.marks(F.struct("t", "tags")).alias("marks"))
    index = cut(matching.name_index(objects), "name-index")
    circles = lookup.resolved_hints(rows, index, objects).select(F.col("hint").alias("__h"), F.struct("lon", "lat", "km").alias("circle"))
    full = cut(rows.join(circles, F.col("hint") == F.col("__h"), "left").drop("__h").withColumns({"named": F.size(query_names("de", "da")) > 0, **of_kind}), "match-rows")
    found = cut(candidates(full.where("not by_item"), objects, index, sources), "match-found")
    shared = found.select("row_id", matching.ref_text("t", "id").alias("thing"))
    groups = claims.conflict_groups(shared, "row_id", "thing").withColumnRenamed("row_id", "__r")
    waiting = cut(full.where("not by_item").join(groups, F.col("row_id") == F.col("__r"), "left").drop("__r").withColumn("conflict", F.coalesce("conflict", F.col("row_id"))), "match-waiting")
    things = cut(shared.distinct().join(waiting.select("row_id", "line", "conflict"), "row_id").select("thing", "line", "conflict"), "match-things")
    done = match_countries(full.where("by_item").withColumn("row_id", F.col("name_id")), countries)
    taken = held
    while waiting.limit(1).count():
        decided = cut(decide(waiting, found, taken).join(waiting.select("row_id", "name_id", "conflict"), "row_id"), "match-pass")
        takes = decided.where("result = 'matched'").select("line", F.explode(F.transform("refs", lambda r: matching.ref_text(r["t"], r["id"]))).alias("thing"))
        first = takes.groupBy("thing").agg(F.min("line").alias("taken"))
        # From the first row of a group on that an earlier one takes something from, nothing is settled yet.
        ahead = decided.select("line", "conflict").join(things, ["line", "conflict"]).join(first, "thing").where(F.col("line") > F.col("taken"))
        stop = cut(ahead.groupBy("conflict").agg(F.min("line").alias("stop")), "match-stop")
        as_named = lambda df: df.withColumn("row_id", F.col("name_id")).drop("name_id", "conflict")
        if stop.isEmpty():
            done = done.unionByName(as_named(decided))
            break
        settled = cut(decided.join(stop, "conflict", "left").where(F.col("stop").isNull() | (F.col("line") < F.col("stop"))).drop("stop"), "match-settled")
        given = settled.where("result = 'matched'").select(F.explode("refs").alias("r"), F.lit(None).cast("string").alias("item"), F.col("name_id").alias("holder")).select("r.t", "r.id", "item", "holder", F.lit(True).alias("given"))
        taken = taken.unionByName(given)
        waiting = cut(waiting.join(settled.select("row_id"), "row_id", "left_anti"), "match-waiting")
        found = cut(found.join(waiting.select("row_id"), "row_id", "left_semi"), "match-found")
        done = done.unionByName(as_named(settled))
    return without_taken_items(cut(done, "match-done"), held)
