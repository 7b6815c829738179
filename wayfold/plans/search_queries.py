"""Ranked search for misspelt and unfinished names, and keys of nested expressions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, ranked
from .queries import query, table


@query("""
WITH w AS (SELECT p_partkey AS key, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[\\s\\p{Z}\\p{P}]+'), lambda x: x <> '') AS ws FROM part),
l AS (SELECT key, len(list_distinct(ws)) AS length, ws FROM w), facts AS (SELECT count(*)::DOUBLE AS n_all, avg(length) AS mean FROM l),
p AS (SELECT term, key, count(*) AS tf, max(length) AS length FROM (SELECT key, length, unnest(ws) AS term FROM l) GROUP BY 1, 2), t AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
q AS (SELECT DISTINCT s.s_suppkey AS query, substr(string_split(lower(p_name), ' ')[1], 1, 1) || substr(string_split(lower(p_name), ' ')[1], 3) || ' ' || substr(string_split(lower(p_name), ' ')[-1], 1, 3) || ' ' || lower(p_brand) AS text FROM supplier s JOIN part ON p_partkey = s_suppkey),
a AS (SELECT query, unnest(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\p{P}]+'), lambda x: x <> '')) AS word FROM q),
e AS (SELECT word, term, n, CASE WHEN term = word THEN 1.0::DOUBLE WHEN starts_with(term, word) THEN 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - length(word)))
    ELSE 0.45::DOUBLE * length(term) / (length(term) + levenshtein(term, word)) END AS weight
    FROM (SELECT DISTINCT word FROM a) JOIN t ON starts_with(term, word) OR levenshtein(term, word) <= least(floor(length(word) * 0.2::DOUBLE + 0.5), 6)),
s AS (SELECT query, key, round(sum(weight * ln(1 + (n_all - n + 0.5) / (n + 0.5)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * length / mean)))) * count(DISTINCT word), 6) AS score
    FROM a JOIN e USING (word) JOIN p USING (term), facts GROUP BY query, key)
SELECT query, key, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS INTEGER) AS place FROM s QUALIFY place <= 8
""")
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """SRT03, PRJ34: as many queries as suppliers, each of a misspelt word, a beginning and a brand, against the names, brands and types of all parts."""
    p = table(spark, d, "part")
    ix = ranked.index(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")), "p_partkey", "text")
    parts = F.split(F.lower("p_name"), " ")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    text = F.concat(F.substring(first, 1, 1), F.substr(first, F.lit(3)), F.lit(" "), F.substring(last, 1, 3), F.lit(" "), F.lower("p_brand"))
    asked = table(spark, d, "supplier").join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), text.alias("query"))
    return ranked.search(ix, asked)


#: Expressions by the remainder of a part's key; %b is its brand, %k its key.
_EXPRESSIONS = (
    '"{name:%b} ({ref}) {}"', '["get", "name:%b"]',
    '["case", ["==", ["get", "kind"], "x"], "{a%k}", ["has", "h"], ["concat", ["get", "f"], "-", ["case", ["get", "no"], ["get", "inner%k"], "{tail}"]], ["get", "fallback"]]',
    '["coalesce", ["get", "g%k"], [["format", ["get", ["get", "nested"]], {"x": ["get", "none"]}], 5, null, true], []]',
)


@query(f"""
WITH RECURSIVE e AS (SELECT p_partkey AS k, replace(replace([{', '.join("'" + x + "'" for x in _EXPRESSIONS)}][p_partkey % 4 + 1], '%b', p_brand), '%k', p_partkey::VARCHAR)::JSON AS v FROM part),
tree AS (SELECT k, v FROM e UNION ALL SELECT k, el FROM (
    SELECT k, v, n, unnest(range(n)) AS place, unnest(json_extract(v, '$[*]')) AS el FROM (SELECT k, v, json_array_length(v)::BIGINT AS n FROM tree WHERE json_type(v) = 'ARRAY' AND NOT coalesce(json_extract_string(v, '$[0]') = 'get' AND json_type(v, '$[1]') = 'VARCHAR', false)))
    WHERE coalesce(json_extract_string(v, '$[0]') <> 'case', true) OR (place > 0 AND (place % 2 = 0 OR place = n - 1)))
SELECT DISTINCT k AS p_partkey, unnest(CASE WHEN json_type(v) = 'VARCHAR' THEN regexp_extract_all(v ->> '$', '\\{{([^}}]+)\\}}', 1) WHEN json_type(v) = 'ARRAY' AND json_extract_string(v, '$[0]') = 'get' AND json_type(v, '$[1]') = 'VARCHAR' THEN [json_extract_string(v, '$[1]')] ELSE []::VARCHAR[] END) AS field FROM tree
""")
def shown_fields(spark: SparkSession, d: str) -> DataFrame:
    """STR24: the fields that nested label expressions show, one expression for each part."""
    p = table(spark, d, "part")
    text = F.element_at(F.array(*[F.lit(x) for x in _EXPRESSIONS]), (F.col("p_partkey") % 4 + 1).cast("int"))
    said = F.replace(F.replace(text, F.lit("%b"), F.col("p_brand")), F.lit("%k"), F.col("p_partkey").cast("string"))
    return nested.shown_keys(p.select("p_partkey", said.alias("expression")), "p_partkey", "expression")
