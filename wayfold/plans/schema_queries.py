"""Schema validation of JSON lines that events make, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import first_problem, schema_errors
from .queries import query, table

#: Tasks that lines are checked in.
PARTS = 96

#: Lines of a log: each action has fields of its own, any other field is refused.
SCHEMA = {
    "type": "object",
    "required": ["id", "action", "props"],
    "properties": {
        "id": {"type": "string", "pattern": "^e[0-9]+$", "minLength": 2},
        "action": {"enum": ["click", "view", "purchase", "signup"]},
        "props": {"$ref": "#/$defs/props"},
    },
    "allOf": [
        {"if": {"properties": {"action": {"const": "click"}}, "required": ["action"]}, "then": {"required": ["lat"], "properties": {"lat": {"type": "number", "minimum": -90, "maximum": 90}, "note": {"$ref": "#/$defs/note"}}}},
        {"if": {"properties": {"action": {"enum": ["view", "purchase"]}}}, "then": {"properties": {"note": {"$ref": "#/$defs/note"}}}},
    ],
    "unevaluatedProperties": False,
    "$defs": {
        "props": {"type": "object", "required": ["k"], "properties": {"k": {"oneOf": [{"type": "integer", "maximum": 60}, {"type": "integer", "minimum": 90}, {"type": "string"}]}}, "additionalProperties": False},
        "note": {"type": "string"},
    },
}


@query("""
WITH l AS (SELECT event_id, event_type, event_id % 5 AS m, event_id % 7 AS lat, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
e AS (SELECT *, event_type = 'error' AS bad_action, m = 4 AS bad_id, k > 60 AND k < 90 AS bad_k, event_type = 'click' AND lat = 0 AS no_lat, event_type = 'click' AND lat IN (5, 6) AS high, event_type IN ('click', 'view', 'purchase') AND m = 3 AS bad_note,
    CASE WHEN event_type = 'click' THEN lat <> 0 WHEN event_type IN ('view', 'purchase') THEN lat <> 0 ELSE lat <> 0 END AS has_lat, m IN (2, 3) AS has_note FROM l),
f AS (SELECT *, CASE event_type WHEN 'click' THEN NOT (no_lat OR high OR bad_note) ELSE false END AS lat_seen,
    CASE event_type WHEN 'click' THEN NOT (no_lat OR high OR bad_note) WHEN 'view' THEN NOT bad_note WHEN 'purchase' THEN NOT bad_note ELSE false END AS note_seen FROM e),
g AS (SELECT *, (has_lat AND NOT lat_seen) OR (has_note AND NOT note_seen) AS beyond FROM f)
SELECT event_id, CAST(bad_action::INT + bad_id::INT + (bad_id AND event_id < 10)::INT + bad_k::INT + no_lat::INT + high::INT + bad_note::INT + beyond::INT AS INTEGER) AS n_errors,
    CASE WHEN no_lat THEN '''lat'' is a required property'
        WHEN bad_action THEN 'action: "error" is not one of ["click", "view", "purchase", "signup"]'
        WHEN bad_id THEN 'id: "' || event_id || '" does not match ''^e[0-9]+$''' WHEN high THEN 'lat: ' || lat * 20 || ' is greater than the maximum of 90'
        WHEN bad_note THEN 'note: 7 is not of type ''string''' WHEN bad_k THEN 'props/k: ' || k || ' is valid under none or several of the given schemas'
        WHEN beyond THEN CASE WHEN has_lat AND NOT lat_seen THEN '''lat''' ELSE '' END || CASE WHEN has_lat AND NOT lat_seen AND has_note AND NOT note_seen THEN ', ' ELSE '' END || CASE WHEN has_note AND NOT note_seen THEN '''note''' ELSE '' END || ' unexpected' END AS problem
FROM g
""")
def schema_problems(spark: SparkSession, d: str) -> DataFrame:
    """CPX01, FLT32, SRT10: what breaks the schema in lines made of events, all errors counted and the most telling one shown."""
    # A row costs much more than its bytes tell, so rows are dealt out by count.
    e = table(spark, d, "events").repartition(PARTS)
    m, lat, key = F.col("event_id") % 5, F.col("event_id") % 7, F.col("event_id").cast("string")
    line = F.concat(
        F.lit('{"id":"'), F.when(m == 4, "").otherwise("e"), key, F.lit('","action":"'), "event_type", F.lit('","props":'), "props",
        F.when(lat == 0, "").otherwise(F.concat(F.lit(',"lat":'), (lat * 20).cast("string"))), F.when(m == 2, ',"note":"n"').when(m == 3, ',"note":7').otherwise(""), F.lit("}"),
    )
    found = e.select("event_id", F.parse_json(line).alias("v")).withColumn("errors", schema_errors(SCHEMA, F.col("v")))
    return found.select("event_id", F.size("errors").alias("n_errors"), first_problem(F.col("errors")).alias("problem"))
