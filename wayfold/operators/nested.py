"""Keys that a nested expression shows, found by a walk over its tree, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Levels of an expression at most; a deeper one is an error.
DEEPEST = 100


def shown_keys(expressions: DataFrame, key: str, expression: str) -> DataFrame:
    """Rows (key, field), distinct: the fields that each expression (JSON text) shows.

    A text shows the ``{field}`` of its template, ``["get", field]`` the field, ``["case",
    condition, output, ..., fallback]`` what its outputs and its fallback show, any other array
    what its elements show; other values show nothing. All expressions are walked level by
    level at once, so a query has as many steps as the deepest has levels. Text that is no JSON
    counts as empty. A tree of more than DEEPEST levels is an error. Levels are written to the
    shared folder, so there may be any number of nodes; a recursive query would allow a fixed number.
    """
    is_array = "startswith(schema_of_variant(v), 'ARRAY')"
    first = "try_variant_get(v, '$[0]', 'string')"
    get = f"({first} <=> 'get' AND schema_of_variant(try_variant_get(v, '$[1]', 'variant')) <=> 'STRING')"
    level = cut(expressions.select(F.col(key).alias("id"), F.to_json(F.try_parse_json(expression)).alias("text")).where("text IS NOT NULL"), "expressions")
    walked = level
    for depth in range(DEEPEST + 1):
        parents = level.select("id", F.parse_json("text").alias("v")).where(f"{is_array} AND NOT {get}")
        if parents.isEmpty():
            break
        if depth == DEEPEST:
            raise RecursionError(f"RECURSION: an expression has more than {DEEPEST} levels")
        places = parents.selectExpr("id", "v", "posexplode(try_variant_get(v, '$', 'array<variant>')) AS (place, element)", "size(try_variant_get(v, '$', 'array<variant>')) AS n")
        below = places.where(f"NOT ({first} <=> 'case') OR (place > 0 AND (place % 2 = 0 OR place = n - 1))")
        level = cut(below.select("id", F.to_json("element").alias("text")), "expressions")
        walked = walked.unionByName(level)
    v = F.parse_json("text")
    said = walked.select("id", v.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    template = F.regexp_extract_all(F.try_variant_get("v", "$", "string"), F.lit(r"\{([^}]+)\}"), F.lit(1))
    found = F.when(F.col("kind") == "STRING", template).when(F.expr(f"{is_array} AND {get}"), F.array(F.try_variant_get("v", "$[1]", "string"))).otherwise(F.array().cast("array<string>"))
    return said.select(F.col("id").alias(key), F.explode(found).alias("field")).distinct()
