"""Outputs made from the given tables, rebuilt and held against their inputs, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Store
from ..sources.tables import shared_dir
from .queries import query, table
from .rebuilds import Outputs, row_differences
from .views import View


def _spent(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order"))


def _nations(customer: DataFrame, spent: DataFrame) -> DataFrame:
    both = customer.select("c_custkey", "c_nationkey").join(spent, "c_custkey", "left")
    return both.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"), F.coalesce(F.sum("n_orders"), F.lit(0)).alias("n_orders"), F.max("last_order").alias("last_order"))


def _sold(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(F.count("*").alias("n_lines"))


VIEWS = [View("nations", ["customer", "spent"], _nations), View("spent", ["orders"], _spent), View("sold", ["lineitem"], _sold)]


def _first_run(spark: SparkSession, d: str) -> tuple[Store, dict[str, DataFrame]]:
    """A store whose outputs were made before a part of the orders came, and the tables as they are now."""
    tables = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem")}
    store = Store(spark, f"{shared_dir(spark)}/wayfold/outputs-{uuid.uuid4().hex}")
    Outputs(store, VIEWS, tables | {"orders": tables["orders"].where("o_orderkey % 11 <> 0")}).update()
    return store, tables


@query("""
WITH s AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
SELECT c_nationkey, count(*) AS n_customers, CAST(coalesce(sum(n_orders), 0) AS BIGINT) AS n_orders, max(last_order) AS last_order, 'nations: done, spent: done, sold: current' AS outcomes FROM customer LEFT JOIN s USING (c_custkey) GROUP BY 1
""")
def rebuilt_outputs(spark: SparkSession, d: str) -> DataFrame:
    """STM15, STM17, STM18, UDF04: outputs after new orders came: those made from orders are rebuilt, in order, and no other."""
    store, tables = _first_run(spark, d)
    got = Outputs(store, VIEWS, tables).update()
    said = ", ".join(f"{name}: {o.state}" for name, o in got.items())
    return store.read("nations").withColumn("outcomes", F.lit(said))


@query("""
WITH was AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1), now AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
SELECT *, CAST(1 AS BIGINT) AS n_published, CAST(0 AS BIGINT) AS n_rebuilt FROM (SELECT * FROM was EXCEPT ALL SELECT * FROM now)
UNION ALL SELECT *, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM was)
""")
def output_differences(spark: SparkSession, d: str) -> DataFrame:
    """STM16, DQ14: rows of a published output that its inputs don't give now, and rows that they give beside it."""
    store, tables = _first_run(spark, d)
    return row_differences(store.read("spent"), Outputs(store, VIEWS, tables).made(VIEWS[1]))
