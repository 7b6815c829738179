"""Queries over a name list made of the customers, and the same in SQL.

A customer is a row of the list: its key is the line, and its cells follow from the key so
that every rule is broken by some rows. Areas go by the key as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import namelist, tiles
from ..operators.naming import Variety
from ..sources import reports
from .queries import _km, _pos, lat_of, lon_of, query, table

VARIETIES = [Variety("frr-x-a", "one", "frr"), Variety("frr-x-b", "two", "frr"), Variety("nds", "nds", "nds")]

_K = "c_custkey"
# Cells by name, in SQL that both engines read.
_CELLS = {
    "id": "'c' || c_custkey", "kind": "CASE c_custkey % 8 WHEN 0 THEN 'settlement' WHEN 1 THEN 'island' WHEN 2 THEN 'koog' WHEN 3 THEN 'water' WHEN 4 THEN 'road' WHEN 5 THEN 'warft' WHEN 6 THEN 'not_a_place' ELSE 'volcano' END",
    "one": "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END", "two": "CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey || ' (r' || c_custkey || ')' ELSE '' END", "nds": "CASE WHEN c_custkey % 5 = 0 THEN 'N' || c_custkey ELSE '' END",
    "local": "CASE WHEN c_custkey % 6 = 0 THEN 'L' || c_custkey || ' (v' || c_custkey || ')' ELSE '' END", "de": "CASE WHEN c_custkey % 7 <> 0 THEN 'de ' || c_custkey || '; x' ELSE '' END", "da": "CASE WHEN c_custkey % 2 = 0 THEN 'da ' || c_custkey END",
    "hint": "CASE WHEN c_custkey % 9 = 0 THEN 'near ' || c_nationkey ELSE '' END", "note": "''", "status": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'auto' WHEN 2 THEN 'ok' WHEN 3 THEN 'skip' ELSE 'maybe' END",
    "osm": "CASE c_custkey % 6 WHEN 0 THEN 'way/' || (c_custkey + 1) || '; node/' || (c_custkey + 2) WHEN 1 THEN 'local/p-' || c_custkey WHEN 2 THEN 'relation/' || (c_custkey + 1) WHEN 3 THEN '' WHEN 4 THEN 'road/' || c_custkey ELSE 'way/' || (c_custkey % 40 + 1) END",
    "wikidata": "CASE c_custkey % 7 WHEN 0 THEN 'Q' || (c_custkey % 100 + 1) WHEN 1 THEN 'q12' WHEN 2 THEN 'Q' || (c_custkey + 1) ELSE '' END",
    "area": "CASE c_custkey % 4 WHEN 0 THEN 'frr-x-a' WHEN 1 THEN 'nds' END", "name_frr": "CASE WHEN c_custkey % 10 < 4 THEN 'F' || c_custkey END", "name_nds": "CASE WHEN c_custkey % 10 > 6 THEN 'S' || c_custkey END",
}
_LIST = f"l AS (SELECT c_custkey AS line, c_nationkey, {', '.join(f'{sql} AS {name}' for name, sql in _CELLS.items())} FROM customer)"
# Names of the cells above without their remarks.
_ONE, _TWO, _NDS, _LOCAL, _DE = "nullif(one, '')", "CASE WHEN two <> '' THEN 'T' || line END", "nullif(nds, '')", "CASE WHEN local <> '' THEN 'L' || line END", "CASE WHEN de <> '' THEN 'de ' || line END"
_ANY = f"coalesce({_ONE}, {_LOCAL}, {_TWO}, '')"
_REFS = "CASE WHEN osm LIKE 'road/%' OR osm = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(osm, '; ') END"
_STATE = f"""CASE WHEN kind = 'not_a_place' THEN 'not a place' WHEN status = 'skip' THEN 'skip' WHEN {_ANY} = '' THEN 'no name' WHEN osm LIKE 'local/%' THEN 'own point'
    WHEN status = 'ok' OR ((osm <> '' OR wikidata <> '') AND status <> 'auto') THEN 'by hand' WHEN osm <> '' OR wikidata <> '' THEN 'auto' ELSE 'open' END"""


def name_list(spark: SparkSession, d: str) -> DataFrame:
    cells = [F.expr(sql).alias(name) for name, sql in _CELLS.items()]
    return table(spark, d, "customer").select(F.col(_K).alias("line"), "c_nationkey", *cells)


@query(f"""
WITH {_LIST}
SELECT line, m.seq AS seq, m.message AS message FROM (SELECT line, unnest(list_filter([
    {{'seq': 0, 'message': CASE WHEN kind = 'volcano' THEN 'unknown kind ''volcano''' END}}, {{'seq': 1, 'message': CASE WHEN status = 'maybe' THEN 'unknown status ''maybe'' (auto / ok / skip / empty)' END}},
    {{'seq': 2, 'message': CASE WHEN osm LIKE 'road/%' THEN 'bad reference ''' || osm || '''' END}}, {{'seq': 3, 'message': CASE WHEN wikidata = 'q12' THEN 'bad wikidata id ''q12''' END}},
    {{'seq': 4, 'message': CASE WHEN wikidata <> '' AND osm LIKE 'local/%' THEN 'a local reference is for a place OSM does not have -- it cannot have a wikidata id' END}}], lambda p: p.message IS NOT NULL)) AS m FROM l)
""")
def list_rules(spark: SparkSession, d: str) -> DataFrame:
    """DQ01, SRC19, SRC20, SRT05: every rule that a row of the list breaks, by line."""
    return namelist.by_line(namelist.row_problems(name_list(spark, d)))


@query(f"""
WITH {_LIST}, odd AS (SELECT line, one || CASE line % 6 WHEN 0 THEN ' (r' WHEN 1 THEN ';x' WHEN 2 THEN ' (r) x' WHEN 3 THEN '  x' WHEN 4 THEN '?' ELSE '; ' || one END AS one, two, coalesce(da, '') AS da FROM l WHERE one <> '')
SELECT line, 'one' AS "column", CASE line % 6 WHEN 0 THEN 'unbalanced brackets' WHEN 1 THEN 'variants are separated by `; ` (no space before, one after)' WHEN 2 THEN 'text after a remark in ''' || one || ''''
    WHEN 3 THEN 'stray spaces in ''' || one || '''' WHEN 4 THEN '`?` in ''' || one || ''' -- say `uncertain` in `note` instead' ELSE split_part(one, ';', 1) || ' twice' END AS message FROM odd
""")
def cell_rules(spark: SparkSession, d: str) -> DataFrame:
    """DQ12, DQ13, STR30: how name cells are written."""
    rows = name_list(spark, d).where("one <> ''")
    n = F.col("line") % 6
    tail = F.when(n == 0, " (r").when(n == 1, ";x").when(n == 2, " (r) x").when(n == 3, "  x").when(n == 4, "?").otherwise(F.concat(F.lit("; "), F.col("one")))
    return namelist.cell_problems(rows.withColumn("one", F.concat("one", tail)), ["one", "two", "da"])


@query(f"""
WITH {_LIST}, h AS (SELECT line, unnest(list_concat({_REFS}, CASE WHEN wikidata <> '' THEN [wikidata] ELSE CAST([] AS VARCHAR[]) END)) AS key FROM l WHERE status <> 'skip'),
f AS (SELECT DISTINCT line, key, min(line) OVER (PARTITION BY key) AS first FROM h), s AS (SELECT *, min(CASE WHEN line > first THEN line END) OVER (PARTITION BY key) AS second FROM f)
SELECT line, key, CASE WHEN line = first THEN second ELSE first END AS holder FROM s WHERE CASE WHEN line = first THEN second ELSE first END IS NOT NULL
""")
def standing_claims(spark: SparkSession, d: str) -> DataFrame:
    """CPX04, CPX05, JN30: what a row holds that another one holds as well."""
    return namelist.standing(name_list(spark, d))


@query(f"""
WITH {_LIST}, s AS (SELECT *, {_STATE} AS state FROM l)
SELECT line, state, state IN ('auto', 'open') AS owned, status <> 'skip' AND (len({_REFS}) > 0 OR wikidata <> '') AND kind <> 'not_a_place' AND {_ANY} <> '' AS on_map,
    CASE WHEN state NOT IN ('auto', 'open') THEN 'line ' || line || ' is not the matcher''s to fill (' || state || ': status=' || coalesce(nullif(status, ''), 'empty') || ', osm=' || coalesce(nullif(osm, ''), '-') || ')' END AS refused FROM s
""")
def rows_on_map(spark: SparkSession, d: str) -> DataFrame:
    """FLT14-FLT16, DQ16: the state of each row, whose it is, and whether it puts names on the map."""
    rows = name_list(spark, d).withColumn("state", namelist.state(VARIETIES))
    return rows.select("line", "state", namelist.is_owned(F.col("state")).alias("owned"), namelist.on_map(VARIETIES).alias("on_map"), namelist.owner_problem(F.col("state")).alias("refused"))


@query(f"""
WITH {_LIST}, n AS (SELECT *, coalesce({_DE}, nullif(da, ''), {_ANY}) AS name FROM l)
SELECT line, name AS point_name, CASE WHEN hint <> '' THEN name || ' (' || hint || ')' ELSE name END AS label, {_ANY} AS any_name,
    CAST((one <> '')::INT + (local <> '')::INT + (two <> '')::INT + (de <> '')::INT + (nds <> '')::INT + (coalesce(da, '') <> '')::INT AS BIGINT) AS n_cells FROM n
""")
def point_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ06-PRJ12, PRJ29, STR15: the names of a point of our own, its label, and the cells that are filled."""
    name = namelist.point_name(VARIETIES)
    cells = F.size(namelist.name_cells(namelist.all_name_columns(VARIETIES))).cast("long")
    return name_list(spark, d).select("line", name.alias("point_name"), namelist.labelled(name).alias("label"), namelist.any_name(VARIETIES).alias("any_name"), cells.alias("n_cells"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    rows = name_list(spark, d).withColumns({"lon": lon_of("line"), "lat": lat_of("line"), "name": F.when(F.col("line") % 8 < 5, F.concat(F.lit("O"), F.col("line").cast("string")))})
    return namelist.resolved(rows, VARIETIES)


_RESOLVED = f"""r AS (SELECT *, {_pos('line')}, CASE WHEN line % 8 < 5 THEN 'O' || line END AS name, coalesce(area, '') AS dialect,
    coalesce({_ONE}, CASE WHEN area = 'frr-x-a' THEN {_LOCAL} END) AS n_a, {_TWO} AS n_b, coalesce({_NDS}, CASE WHEN area = 'nds' THEN {_LOCAL} END, name_nds) AS n_c,
    coalesce({_LOCAL}, CASE area WHEN 'frr-x-a' THEN {_ONE} WHEN 'nds' THEN {_NDS} END, '') AS listed, coalesce(CASE area WHEN 'frr-x-a' THEN name_frr WHEN 'nds' THEN name_nds END, '') AS osm_local, CASE WHEN local <> '' THEN 'v' || line ELSE '' END AS variety FROM l)"""


@query(f"""
WITH {_LIST}, {_RESOLVED}
SELECT line, coalesce(n_a, '') AS first, coalesce(n_b, '') AS second, coalesce(n_c, '') AS nds, coalesce(nullif(listed, ''), osm_local) AS local, osm_local <> '' AND listed = '' AS from_osm, variety, dialect,
    CAST((n_a IS NOT NULL)::INT + (n_b IS NOT NULL)::INT + (n_c IS NOT NULL)::INT + 2 + (de <> '')::INT + (dialect <> '')::INT + (coalesce(nullif(listed, ''), osm_local) <> '')::INT + (variety <> '')::INT AS BIGINT) AS n_tags FROM r
""")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ18, PRJ20-PRJ24, PRJ26, STR29, FLT31: the names and attributes that a row gives its object, and its tags."""
    r = _resolved(spark, d)
    of = lambda t: F.coalesce(F.col("names")[t], F.lit(""))
    return r.select("line", of("frr-x-a").alias("first"), of("frr-x-b").alias("second"), of("nds").alias("nds"), F.col("local_name").alias("local"), F.col("local_from_osm").alias("from_osm"), "variety", "dialect", F.size(namelist.as_tags()).cast("long").alias("n_tags"))


@query(f"""
WITH {_LIST}, {_RESOLVED}, e AS (SELECT line, coalesce(nullif(listed, ''), osm_local) AS loc, * FROM r)
SELECT line, id AS id, round(lon, 5) AS lon, round(lat, 5) AS lat, nullif(loc, '') AS local, name AS name_osm, nullif(da, '') AS name_da, nullif(osm, '') AS osm, nullif(wikidata, '') AS wikidata,
    CAST(6 + (loc <> '')::INT + (dialect <> '')::INT + (variety <> '')::INT + (name IS NOT NULL)::INT + (coalesce(da, '') <> '')::INT + (osm <> '')::INT + (wikidata <> '')::INT AS BIGINT) AS n_fields FROM e
""")
def search_entries(spark: SparkSession, d: str) -> DataFrame:
    """PRJ19, SNK12: search entries as JSON, read back: optional fields only where they are not empty."""
    e = _resolved(spark, d).select("line", namelist.as_entry().alias("j"))
    field = lambda k: F.get_json_object("j", f"$.{k}")
    return e.select("line", field("id").alias("id"), *[field(k).cast("double").alias(k) for k in ("lon", "lat")], *[field(k).alias(k) for k in ("local", "name_osm", "name_da", "osm", "wikidata")], F.size(F.json_object_keys("j")).cast("long").alias("n_fields"))


@query(f"""
WITH {_LIST}, {_RESOLVED} SELECT line, osm_local AS local, CASE WHEN osm_local <> '' THEN dialect ELSE '' END AS dialect FROM r
""")
def unclaimed_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ25: the local name of objects that no row claims, with their area."""
    m = namelist.unclaimed_tags(F.col("area"), VARIETIES)
    rows = name_list(spark, d).withColumn("m", m)
    of = lambda k: F.coalesce(F.col("m")[k], F.lit(""))
    return rows.select("line", of(namelist.naming.LOCAL).alias("local"), of(namelist.TILE_KEYS["dialect"]).alias("dialect"))


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that were located: orders by key; their tags say what is known of them."""
    o = table(spark, d, "orders").where("o_orderkey % 3 > 0")
    t = F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), (F.col("o_custkey") % 3 + 1).cast("int"))
    m = F.create_map(F.lit("boundary"), F.when(F.col("o_orderkey") % 2 == 0, "administrative").otherwise("x"), F.lit("admin_level"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("8"), F.lit("name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.lit("name:nds"), F.lit(""), F.lit("name:frr"), F.col("o_orderstatus"))
    o = o.select(t.alias("t"), F.col("o_orderkey").alias("id"), lon_of("o_orderkey").alias("lon"), lat_of("o_orderkey").alias("lat"), lon_of("o_custkey").alias("lon2"), lat_of("o_custkey").alias("lat2"), namelist.object_facts(m).alias("facts"))
    return o


_OBJECTS = f"""o AS (SELECT ['n', 'w', 'r'][o_custkey % 3 + 1] AS t, o_orderkey AS id, {_pos('o_orderkey')}, {_pos('o_custkey').replace('AS lon', 'AS lon2').replace('AS lat', 'AS lat2')},
    CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 8 END AS admin_level, 'o' || o_orderkey AS name, o_orderstatus AS name_frr FROM orders WHERE o_orderkey % 3 > 0),
p AS (SELECT CASE WHEN line % 2 = 0 THEN split_part(osm, ';', 1) ELSE osm END AS ref, {_pos('(line + 5)')} FROM l WHERE line % 6 IN (1, 2) AND line % 4 <> 3)"""


@query(f"""
WITH {_LIST}, {_OBJECTS}, n AS (SELECT *, coalesce({_DE}, nullif(da, ''), {_ANY}) AS own, CASE WHEN osm = '' OR osm LIKE 'road/%' THEN '' ELSE split_part(osm, ';', 1) END AS ref FROM l),
j AS (SELECT n.*, o.lon, o.lat, o.lon2, o.lat2, o.name, o.name_frr AS frr, o.admin_level, o.id AS oid, p.lon AS plon, p.lat AS plat, n.ref LIKE 'local/%' AS loc FROM n
    LEFT JOIN o ON n.ref = CASE o.t WHEN 'n' THEN 'node/' WHEN 'w' THEN 'way/' ELSE 'relation/' END || o.id LEFT JOIN p ON p.ref = n.ref AND n.ref <> '')
SELECT id AS row_id, CASE WHEN (loc OR oid IS NOT NULL) AND plon IS NOT NULL THEN plon WHEN NOT loc THEN lon END AS lon, CASE WHEN (loc OR oid IS NOT NULL) AND plon IS NOT NULL THEN plat WHEN NOT loc THEN lat END AS lat,
    CASE WHEN NOT loc AND plon IS NULL THEN lon2 END AS lon2, CASE WHEN NOT loc AND plon IS NULL THEN lat2 END AS lat2, CASE WHEN loc AND plon IS NOT NULL THEN nullif(own, '') WHEN NOT loc THEN name END AS name,
    CAST(NULL AS VARCHAR) AS name_nds, CASE WHEN NOT loc THEN frr END AS name_frr, CASE WHEN NOT loc THEN admin_level END AS admin_level,
    CASE WHEN ref = '' THEN NULL WHEN loc AND plon IS NULL THEN ref || ' has no position' WHEN NOT loc AND oid IS NULL THEN ref || ' has no object' END AS problem FROM j
""")
def located_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC28, PRJ13-PRJ15, JN23, JN24, JN38, JN40: what each row stands for and where that lies."""
    rows = name_list(spark, d)
    at = rows.where("line % 6 IN (1, 2) AND line % 4 <> 3").withColumn("k", F.col("line") + 5)
    positions = at.select(F.substring_index("osm", ";", 1).alias("ref"), lon_of("k").alias("lon"), lat_of("k").alias("lat"))
    return namelist.located(rows, _objects(spark, d), positions, VARIETIES)


@query(f"""
WITH {_LIST}, m AS (SELECT * FROM l WHERE status <> 'skip' AND (len({_REFS}) > 0 OR wikidata <> '') AND kind <> 'not_a_place' AND {_ANY} <> ''), {_OBJECTS},
w AS (SELECT ref, max(line) AS line FROM (SELECT line, unnest({_REFS}) AS ref FROM m) WHERE ref NOT LIKE 'local/%' GROUP BY 1)
SELECT 'c' || line AS row_id, line, ref, CASE WHEN line % 2 = 0 AND ref LIKE 'way/%' THEN 'is in none of the extracts' ELSE 'is not located yet' END AS why FROM w
WHERE ref NOT IN (SELECT CASE t WHEN 'n' THEN 'node/' WHEN 'w' THEN 'way/' ELSE 'relation/' END || id FROM o)
""")
def unlocated_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN20-JN22, DQ15, SET04: references of rows on the map without an object, and what to do about them."""
    rows = name_list(spark, d)
    asked = namelist.named_refs(rows, VARIETIES).groupBy("t", "id").agg(F.max("line").alias("line")).where("t = 'w' AND line % 2 = 0")
    return namelist.unlocated(rows, _objects(spark, d), asked, VARIETIES)


_MATCHES = "m AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN 'gone' || o_custkey ELSE 'c' || o_custkey END AS row_id, CASE o_custkey % 3 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'not found' ELSE 'matched' END AS result, count(*)::VARCHAR || ' candidates' AS why FROM orders GROUP BY o_custkey)"
_WORK = f"""w AS (SELECT m.row_id, m.result, m.why, l.line, l.kind, {_ANY} AS name, coalesce({_DE}, '') AS name_de, CASE WHEN l.line IS NULL THEN 'stale' WHEN {_STATE} NOT IN ('auto', 'open') THEN 'unowned' ELSE 'kept' END AS fate FROM m LEFT JOIN l ON l.id = m.row_id WHERE m.result <> 'matched')"""


def _work(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    key = F.col("o_custkey").cast("string")
    result = F.when(F.col("o_custkey") % 3 == 0, "ambiguous").when(F.col("o_custkey") % 3 == 1, "not found").otherwise("matched")
    matches = o.select(F.concat(F.when(F.col("o_custkey") % 50 == 0, "gone").otherwise("c"), key).alias("row_id"), result.alias("result"), F.concat(F.col("n").cast("string"), F.lit(" candidates")).alias("why"))
    return namelist.work_rows(name_list(spark, d), matches, VARIETIES)


@query(f"""
WITH {_LIST}, {_MATCHES}, {_WORK}
SELECT row_id, result, why, fate, line, name, name_de, regexp_replace(lower(coalesce(nullif(name_de, ''), name)), '[^a-z0-9]+', '-', 'g') AS slug,
    CAST(row_number() OVER (PARTITION BY kind, fate ORDER BY line) AS INTEGER) AS place FROM w WHERE fate = 'kept'
""")
def worklist_rows(spark: SparkSession, d: str) -> DataFrame:
    """JN29, PRJ28, SRT06, SRT07, FLT24: rows to work through, in order of kind and line."""
    return _work(spark, d).where("fate = 'kept'").select("row_id", "result", "why", "fate", "line", "name", "name_de", "slug", "place")


@query(f"""
WITH {_LIST}, {_MATCHES}, {_WORK}
SELECT count(*) FILTER (fate = 'kept') AS rows, count(*) FILTER (fate = 'kept' AND result = 'ambiguous') AS ambiguous, count(*) FILTER (fate = 'kept' AND result = 'not found') AS not_found,
    count(*) FILTER (fate = 'unowned') AS unowned, count(*) FILTER (fate = 'stale') AS stale FROM w
""")
def worklist_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG18, AGG25: what the list of work has and what it leaves out."""
    return namelist.work_summary(_work(spark, d))


_REPORT = "r AS (SELECT row_id, line, kind, name, name_de, why, CASE WHEN fate <> 'kept' THEN 'by hand' WHEN result = 'ambiguous' THEN 'ambiguous' ELSE 'not found' END AS state FROM w WHERE line IS NOT NULL)"


@query(f"""
WITH {_LIST}, {_MATCHES}, {_WORK}, {_REPORT},
c AS (SELECT kind, min(line) AS first, {', '.join(f"count(*) FILTER (state = '{s}') AS s{i}" for i, s in enumerate(reports.STATES))}, count(*) AS n FROM r GROUP BY kind)
SELECT 1 AS section, CAST(first AS BIGINT) AS place, '| ' || concat_ws(' | ', kind, {', '.join(f's{i}' for i in range(len(reports.STATES)))}, n) || ' |' AS text FROM c
UNION ALL SELECT 1, 9223372036854775807, '| ' || concat_ws(' | ', '**total**', {', '.join(f"'**' || coalesce(sum(s{i}), 0)::BIGINT || '**'" for i in range(len(reports.STATES)))}, '**' || coalesce(sum(n), 0)::BIGINT || '**') || ' |' FROM c
UNION ALL SELECT 2, line, '| ' || concat_ws(' | ', row_id, line, kind, name, name_de, '', why, '`' || row_id || '`') || ' |' FROM r WHERE state = 'ambiguous'
UNION ALL SELECT 3, line, '| ' || concat_ws(' | ', row_id, line, kind, name, name_de, '', '`' || row_id || '`') || ' |' FROM r WHERE state = 'not found'
UNION ALL VALUES (1, -2, '| kind | {' | '.join(reports.STATES)} | total |'), (1, -1, '|---|{'---:|' * (len(reports.STATES) + 1)}'),
    (2, -2, '| id | line | kind | Frisian | German | hint | why | candidates |'), (2, -1, '|---|---:|---|---|---|---|---|---|'), (3, -2, '| id | line | kind | Frisian | German | note | near misses |'), (3, -1, '|---|---:|---|---|---|---|---|')
""")
def match_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK14, AGG02, AGG03: the lines of a report on a match run: counts by kind and state, rows to decide, rows not found."""
    w = _work(spark, d).where("line IS NOT NULL")
    state = F.when(F.col("fate") != "kept", "by hand").when(F.col("result") == "ambiguous", "ambiguous").otherwise("not found")
    rows = w.select("row_id", "line", "kind", "name", F.col("name_de").alias("german"), state.alias("state"), F.lit("").alias("hint"), "why", F.col("row_id").alias("candidates"), F.lit("").alias("note"))
    return reports.report_lines(rows)


@query(f"""
SELECT p_partkey, p_name AS name, coalesce(nullif(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, ''), '-') AS class, CASE WHEN p_partkey % 5 > 0 THEN CAST(round_even({_km('lon', 'lat', '8.9::DOUBLE', '54.7::DOUBLE')}, 0) AS INTEGER) END AS km FROM (SELECT *, {_pos('p_partkey')} FROM part)
""")
def candidate_summaries(spark: SparkSession, d: str) -> DataFrame:
    """PRJ05, PRJ27: how a candidate is shown."""
    p = table(spark, d, "part").withColumns({"lon": F.when(F.col("p_partkey") % 5 > 0, lon_of("p_partkey")), "lat": lat_of("p_partkey")})
    return p.select("p_partkey", namelist.candidate_summary(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")), F.col("lon"), F.col("lat")).alias("s")).select("p_partkey", "s.*")


@query(f"""
WITH {_LIST}, {_RESOLVED}, t AS (SELECT unnest(list_filter([CASE WHEN n_a IS NOT NULL THEN 'frr-x-a' END, CASE WHEN n_b IS NOT NULL THEN 'frr-x-b' END, CASE WHEN n_c IS NOT NULL THEN 'nds' END], lambda x: x IS NOT NULL)) AS tag FROM r),
a AS (SELECT dialect AS tag, count(*) AS n FROM r WHERE dialect <> '' GROUP BY 1)
SELECT 'names' AS what, CASE tag WHEN 'frr-x-a' THEN 0 WHEN 'frr-x-b' THEN 1 ELSE 2 END AS place, tag, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'areas', CAST(row_number() OVER (ORDER BY n DESC, tag) AS INTEGER), tag, n FROM a
""")
def variety_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG24, AGG14: names by variety in the order of the registry, objects by area, the most common first."""
    r = _resolved(spark, d)
    names = namelist.counts_by_variety(r, VARIETIES).select(F.lit("names").alias("what"), F.col("seq").alias("place"), "tag", "n")
    return names.unionByName(namelist.counts_by_area(r).select(F.lit("areas").alias("what"), "place", "tag", "n"))


@query("""
WITH g AS (SELECT n_nationkey AS line, CASE WHEN n_nationkey % 9 = 8 THEN '' WHEN n_nationkey % 9 = 7 THEN 'frr-x-v0' WHEN n_nationkey % 9 = 6 THEN 'frr' WHEN n_nationkey % 9 = 5 THEN 'nds-x-' || n_nationkey ELSE 'frr-x-v' || n_nationkey END AS tag, n_nationkey % 9 AS k, n_regionkey FROM nation)
SELECT line, CASE WHEN k = 7 THEN 'duplicate tag or column' WHEN k = 6 THEN 'no variety in the tag' WHEN k = 5 THEN 'tag of another language' WHEN k = 4 THEN 'bad column name' WHEN k = 3 THEN 'a reserved column' WHEN k = 2 THEN 'bad status' WHEN k = 1 THEN 'no label' END AS message
FROM g WHERE tag <> '' AND k > 0 AND k < 8
""")
def registry_rules(spark: SparkSession, d: str) -> DataFrame:
    """DQ06, SRC21, SRC22, STR17: the first rule that a row of the registry breaks."""
    n = table(spark, d, "nation")
    key, k = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 9
    tag = F.when(k == 8, "").when(k == 7, "frr-x-v0").when(k == 6, "frr").when(k == 5, F.concat(F.lit("nds-x-"), key)).otherwise(F.concat(F.lit("frr-x-v"), key))
    rows = n.select(
        F.col("n_nationkey").alias("line"), tag.alias("tag"), F.lit("frr").alias("language"), F.when(k == 4, "Bad Name").when(k == 3, "local").otherwise(F.concat(F.lit("c"), key)).alias("column"),
        F.when(k == 1, "").otherwise(F.col("n_name")).alias("label"), F.when(k == 2, "asleep").otherwise("living").alias("status"), F.when(F.col("n_regionkey") == 0, "no").otherwise("yes").alias("view"),
    )
    return namelist.registry_problems(rows)


@query("""
WITH a AS (SELECT s_suppkey AS line, CASE WHEN s_suppkey % 11 = 0 THEN 'none' ELSE 'frr-x-a' END AS dialect, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 'way/' || s_suppkey || '; node/' || s_suppkey ELSE 'relation/' || (s_suppkey // 2 * 2) END AS osm FROM supplier WHERE s_suppkey > 1),
o AS (SELECT *, CASE WHEN dialect = 'none' THEN 'unknown dialect ''none''' WHEN osm = '' THEN 'no OSM reference' WHEN osm LIKE '%node%' THEN split_part(osm, '; ', 2) || ': only way/ or relation/ references are allowed here' END AS own FROM a),
f AS (SELECT *, min(CASE WHEN own IS NULL THEN line END) OVER (PARTITION BY osm) AS first FROM o)
SELECT line, coalesce(own, CASE WHEN first < line THEN osm || ' is already on line ' || first END) AS problem FROM f
""")
def area_rules(spark: SparkSession, d: str) -> DataFrame:
    """SRC26, WIN12, JN27: rows of the area list, the first rule each breaks, references held by earlier rows."""
    s, key = table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    osm = F.when(F.col("s_suppkey") % 7 == 0, "").when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("way/"), key, F.lit("; node/"), key)).otherwise(F.concat(F.lit("relation/"), (F.floor(F.col("s_suppkey") / 2) * 2).cast("string")))
    rows = s.where("s_suppkey > 1").select(F.col("s_suppkey").alias("line"), F.when(F.col("s_suppkey") % 11 == 0, "none").otherwise("frr-x-a").alias("dialect"), osm.alias("osm"), F.lit("").alias("name"))
    return namelist.area_rows(rows, [v.tag for v in VARIETIES]).select("line", "problem")


@query(f"""
WITH {_LIST}, r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '8' WHEN c_custkey % 3 = 1 THEN '6' ELSE '4' END AS level, c_custkey % 4 = 0 AS city, lpad((c_custkey % 17 + 1040)::VARCHAR, 5, '0') || c_custkey AS ags, CASE WHEN c_nationkey < 20 THEN 'd' || (c_nationkey % 4) END AS dialect, c_name FROM customer),
f AS (SELECT * FROM r WHERE (level = '8' OR (level = '6' AND city)) AND (ags LIKE '01054%' OR ags LIKE '0104%') AND id % 5 <> 0 AND id % 7 <> 0)
SELECT dialect, CASE dialect WHEN 'd2' THEN 1 WHEN 'd0' THEN 2 ELSE CASE WHEN dialect IS NULL THEN 4 ELSE 3 END END AS rank, count(*) AS n, array_to_string(list_sort(list(c_name)), ',') AS names FROM f GROUP BY 1
""")
def municipalities_by_variety(spark: SparkSession, d: str) -> DataFrame:
    """FLT17, JN27, JN28, AGG16, SRT09: municipalities that no row and no earlier extract has, grouped in list order, unassigned last."""
    c = table(spark, d, "customer")
    level = F.when(F.col(_K) % 3 == 0, "8").when(F.col(_K) % 3 == 1, "6").otherwise("4")
    ags = F.concat(F.lpad((F.col(_K) % 17 + 1040).cast("string"), 5, "0"), F.col(_K).cast("string"))
    m = F.create_map(F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), level, F.lit("place"), F.when(F.col(_K) % 4 == 0, "city").otherwise(""), F.lit("de:regionalschluessel"), ags)
    dialect = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("d"), (F.col("c_nationkey") % 4).cast("string")))
    relations = c.select(F.col(_K).alias("id"), m.alias("tags"), dialect.alias("dialect"), F.col("c_name").alias("name"))
    claimed = c.where("c_custkey % 5 = 0").select(F.lit("r").alias("t"), F.col(_K).alias("id"))
    left = namelist.unclaimed_relations(relations, claimed, c.where("c_custkey % 7 = 0").select(F.col(_K).alias("id")), ["01054", "0104"])
    return namelist.parts_by_variety(left, ["d2", "d0"]).select("dialect", "rank", "n", F.array_join("names", ",").alias("names"))


@query(f"""
WITH {_LIST}, a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'c' || s_suppkey WHEN 1 THEN 'way/' || (s_suppkey + 1) WHEN 2 THEN 'node/' || (s_suppkey + 2) || '#7' ELSE 'way/none' END AS key FROM supplier),
k AS (SELECT k, min(how || entry) AS best FROM (SELECT id AS k, '0' AS how, id AS entry FROM l UNION ALL SELECT unnest(string_split(osm, '; ')), '1', id FROM l WHERE osm <> '') GROUP BY 1)
SELECT s_suppkey, key, coalesce(x.best[2:], y.best[2:]) AS entry FROM a LEFT JOIN k x ON x.k = key LEFT JOIN k y ON y.k = regexp_replace(key, '#[^#]*$', '')
""")
def entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN31, JN42: the entry that an id or a reference speaks of."""
    key = F.col("s_suppkey")
    asked = F.when(key % 4 == 0, F.concat(F.lit("c"), key.cast("string"))).when(key % 4 == 1, F.concat(F.lit("way/"), (key + 1).cast("string"))).when(key % 4 == 2, F.concat(F.lit("node/"), (key + 2).cast("string"), F.lit("#7"))).otherwise("way/none")
    return namelist.entry_lookup(table(spark, d, "supplier").select("s_suppkey", asked.alias("key")), name_list(spark, d).select("id", "osm"))


@query("""
WITH h AS (SELECT p_name AS name, p_partkey AS place, 'Q' || p_partkey AS item, p_size % 5 = 0 AS good FROM part)
SELECT name, coalesce(arg_min(item, place) FILTER (good), '') AS item FROM h GROUP BY name
""")
def first_country(spark: SparkSession, d: str) -> DataFrame:
    """SRC32: the first hit that is of a class asked for."""
    p = table(spark, d, "part")
    classes = F.array(F.lit("Qx"), F.when(F.col("p_size") % 5 == 0, "Q6256").otherwise("Q5"))
    hits = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item"), classes.alias("classes"))
    return namelist.first_country(hits, ["Q6256", "Q3624078"])


@query("""SELECT count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT s_suppkey FROM supplier)) AS new, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders)) AS gone FROM orders""")
def other_references(spark: SparkSession, d: str) -> DataFrame:
    """JN41: how many references are new, and how many gone."""
    return namelist.other_references(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), ["k"])


@query(f"""
WITH {_LIST}, e AS (SELECT *, CASE line % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'local' WHEN 2 THEN 'skip' ELSE 'clear' END AS action, CASE WHEN line % 3 = 0 THEN 2.5::DOUBLE END AS km2 FROM l)
SELECT line, CASE action WHEN 'osm' THEN 'way/' || (line + 1) WHEN 'local' THEN 'local/p-' || line WHEN 'skip' THEN '' END AS osm, CASE action WHEN 'osm' THEN 'Q' || line WHEN 'clear' THEN NULL ELSE '' END AS wikidata,
    CASE action WHEN 'osm' THEN 'ok' WHEN 'local' THEN 'ok' WHEN 'skip' THEN 'skip' END AS status, CASE WHEN km2 IS NOT NULL THEN 'place=island' ELSE '' END AS set_tags, CASE WHEN km2 IS NOT NULL THEN '2.5' ELSE '' END AS polygon_km2,
    CASE WHEN km2 IS NULL AND kind NOT IN ('settlement', 'island', 'warft') THEN 'kind=' || kind || ' has no class of its own for a point' END AS warning FROM e
""")
def decisions_written(spark: SparkSession, d: str) -> DataFrame:
    """STM10-STM12, UDF03, CPX06, PRJ43: what each action writes into a row, and into the curation for a place that is not there."""
    key = F.col("line").cast("string")
    n = F.col("line") % 4
    rows = name_list(spark, d).withColumns({
        "action": F.when(n == 0, "osm").when(n == 1, "local").when(n == 2, "skip").otherwise("clear"), "slug": F.concat(F.lit("p-"), key), "ref": F.concat(F.lit("way/"), (F.col("line") + 1).cast("string")), "item": F.concat(F.lit("Q"), key),
        "lat": F.lit(54.5), "lon": F.lit(8.25), "polygon_km2": F.when(F.col("line") % 3 == 0, F.lit(2.5)),
    })
    w, c = namelist.written(), namelist.local_decision()
    return rows.select("line", w["osm"].alias("osm"), w["wikidata"].alias("wikidata"), w["status"].alias("status"), c["curation"]["set_tags"].alias("set_tags"), c["curation"]["polygon_km2"].alias("polygon_km2"), c["warning"].alias("warning"))


@query(f"""
WITH n AS (SELECT p_partkey AS id, {_pos('p_partkey')} FROM part WHERE p_partkey % 4 <> 3), w AS (SELECT l_orderkey AS id, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS node FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY 1),
c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS label FROM customer), o AS (SELECT o_custkey AS key, w.node FROM orders JOIN w ON w.id = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT c.key AS key, coalesce(a.lon, b.lon) AS lon, coalesce(a.lat, b.lat) AS lat FROM c LEFT JOIN n a ON a.id = c.label LEFT JOIN o ON o.key = c.key LEFT JOIN n b ON b.id = o.node
""")
def outline_points(spark: SparkSession, d: str) -> DataFrame:
    """GEO18: the label node, else the first node of the first way that is there."""
    nodes = table(spark, d, "part").where("p_partkey % 4 <> 3").select(F.col("p_partkey").alias("id"), lon_of("p_partkey").alias("lon"), lat_of("p_partkey").alias("lat"))
    li = table(spark, d, "lineitem").where("l_orderkey % 6 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    ways = li.select("id", F.transform("a", lambda x: x["l_partkey"]).alias("nodes"))
    outer = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("outer"))
    own = table(spark, d, "customer").select(F.col(_K).alias("key"), F.when(F.col(_K) % 3 == 0, F.col(_K)).alias("label")).join(outer, "key", "left")
    return namelist.outline_point(own, ways, nodes)


@query(f"""
WITH {_LIST}, t AS (SELECT line, CASE WHEN line % 2 = 0 THEN 'A' || line ELSE '' END AS a, CASE WHEN line % 3 = 0 THEN 'B' || line END AS b, coalesce(nullif(CASE WHEN line % 5 = 0 THEN '' ELSE 'de' || line END, ''), 'german') AS de FROM l)
SELECT line, coalesce(nullif(a, ''), b) AS name, de, CASE WHEN line % 6 = 0 THEN 'frr-x-a' ELSE 'local' END AS local_source, CASE WHEN line % 2 = 0 AND line % 6 <> 0 THEN 'x:A' || line ELSE '' END || CASE WHEN line % 3 = 0 THEN 'z:Z' ELSE '' END AS lines FROM t
""")
def tile_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ32, PRJ40, PRJ41: names out of a tile's properties, and the lines of a card."""
    n, key = F.col("line"), F.col("line").cast("string")
    props = F.create_map(F.lit("name:a"), F.when(n % 2 == 0, F.concat(F.lit("A"), key)).otherwise(""), F.lit("name:b"), F.when(n % 3 == 0, F.concat(F.lit("B"), key)), F.lit("name:de"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("de"), key)), F.lit("name_de"), F.lit("german"))
    rows = name_list(spark, d).select("line", props.alias("p")).withColumn("t", namelist.names_of_tile(F.col("p"), {"name": ("name:a", "name:b"), "de": ("name:de", "name_de")}))
    local = F.when(n % 6 == 0, F.concat(F.lit("A"), key)).otherwise("own")
    names = F.create_map(F.lit("frr-x-a"), F.concat(F.lit("A"), key), F.lit("x"), F.when(n % 2 == 0, F.concat(F.lit("A"), key)).otherwise(""), F.lit("y"), F.lit("head"), F.lit("z"), F.when(n % 3 == 0, "Z"))
    lines = namelist.variety_lines(names, ["x", "y", "z"], F.lit("head"), F.lit("w"), local)
    return rows.select("line", "t.name", "t.de", namelist.local_source(local, F.lit("frr-x-a"), names).alias("local_source"), F.array_join(F.transform(lines, lambda x: F.concat(x["tag"], F.lit(":"), x["name"])), "").alias("lines"))


@query("""
SELECT o_custkey AS key, min(o_orderpriority) FILTER (o_orderpriority <> '5-LOW') AS told FROM orders GROUP BY 1
""")
def telling_problems(spark: SparkSession, d: str) -> DataFrame:
    """SRT10: of the problems of one thing the most telling."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderpriority") == "5-LOW", "0 unexpected").otherwise(F.col("o_orderpriority")).alias("message"))
    got = namelist.telling_first(o, "key")
    return got.select("key", F.when(F.col("message") != "0 unexpected", F.col("message")).alias("told"))


@query("""
SELECT event_id AS line, coalesce(c_custkey, 0) AS row_line, CAST(row_number() OVER (ORDER BY coalesce(c_custkey, 0), event_id) AS BIGINT) AS place FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0
""")
def patch_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT08: lines of a log in order of their rows, then their own, numbered by ranges."""
    rows = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col(_K).cast("string").alias("id"), F.col(_K).alias("line"))
    log = namelist.with_added_columns(table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("line")), ["line", "note", "id"])
    ordered = namelist.patch_order(log, rows).withColumn("order", F.struct("row_line", "line"))
    return tiles.running(ordered, "order", F.lit(1), "before").select("line", "row_line", (F.col("before") + 1).alias("place"))


@query("""
SELECT n_nationkey, d AS label, 'v' || n_nationkey AS digest FROM (SELECT n_nationkey, 'a' || n_regionkey AS d FROM nation) WHERE n_nationkey % 2 = 0
""")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    """CPX09, CPX11: a stamp written as JSON inside JSON, and read back."""
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.lit("a"), F.col("n_regionkey").cast("string")).alias("label"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("digest"))
    made = n.groupBy("n_nationkey").agg(namelist.stamp_json().alias("j")).select("n_nationkey", F.to_json(F.struct(F.from_json("j", "map<string,string>").alias("built_from"), F.lit("x").alias("other"))).alias("description"))
    return made.select("n_nationkey", F.explode(namelist.parse_built_from(F.col("description"))).alias("label", "digest"))
