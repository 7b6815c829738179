"""Objects put into a stream of an extract: made nodes before its first way, made ways before its first relation.

An extract comes by as rows (src, seq, t, id, lon, lat, nodes, tags), ascending in seq: nodes,
ways, relations and last a row of type ``e``. The first row that is no node is the sign that all nodes
have passed, the first that is neither node nor way that all ways have. What is made takes ids
above the highest that has passed. Of a source only these signs and highest ids are kept from
one micro-batch to the next, so rows need no order within a batch and a source of any size is
worked on by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import square_around
from ..functions.tags import overlaid

ROWS = "src string, seq long, t string, id long, lon double, lat double, nodes array<long>, tags map<string,string>"
OUT = f"part int, {ROWS}"
STATE = "src string, high_n long, high_w long, way_at long, relation_at long, base_n long, base_w long"
#: Type of the row that ends a source, and the part of a row that has passed: what is made before it has lower parts.
END, PASSED = "e", (1 << 31) - 1
#: What a square takes over from the object it is put on.
INHERITED = ("name", "short_name", "alt_name", "loc_name", "old_name")
LANGUAGE = "name:"


def inherited(tags: Column, changes: Column) -> Column:
    """Tags of a square: the names of its object, then the changes of its own."""
    names = F.map_filter(tags, lambda k, v: k.isin(*INHERITED) | F.startswith(k, F.lit(LANGUAGE)))
    return F.when(changes.isNull(), names).otherwise(overlaid(names, changes))


def _signs(rows: DataFrame) -> DataFrame:
    """Of each source in a batch: where the first row after its nodes and after its ways is, and the highest ids before these."""
    first = lambda *kinds: F.min(F.when(F.col("t").isin(*kinds), F.col("seq")))
    at = rows.groupBy("src").agg(first("w", "r", END).alias("way_at"), first("r", END).alias("relation_at"))
    before = lambda t, end: F.max(F.when((F.col("t") == t) & (F.col(end).isNull() | (F.col("seq") < F.col(end))), F.col("id")))
    return rows.select("src", "seq", "t", "id").join(at, "src").groupBy("src").agg(before("n", "way_at").alias("high_n"), before("w", "relation_at").alias("high_w"), F.max("way_at").alias("way_at"), F.max("relation_at").alias("relation_at"))


def advanced(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The state (STATE) after a batch; base_n and base_w are the highest ids when the signs came."""
    b = _signs(rows).select("src", *[F.col(c).alias(f"b_{c}") for c in ("high_n", "high_w", "way_at", "relation_at")])
    both = state.join(b, "src", "full")
    high = lambda c, sign: F.when(F.col(sign).isNull(), F.greatest(c, f"b_{c}")).otherwise(F.col(c)).alias(c)
    at = lambda c: F.coalesce(c, f"b_{c}").alias(c)
    out = both.select("src", high("high_n", "way_at"), high("high_w", "relation_at"), at("way_at"), at("relation_at"), "base_n", "base_w")
    base = lambda c, sign, h: F.coalesce(c, F.when(F.col(sign).isNotNull(), F.coalesce(h, F.lit(0)))).alias(c)
    return out.select("src", "high_n", "high_w", "way_at", "relation_at", base("base_n", "way_at", "high_n"), base("base_w", "relation_at", "high_w"))


def made(before: DataFrame, after: DataFrame, points: DataFrame, squares: DataFrame) -> DataFrame:
    """Rows (OUT) that become due between two states.

    ``points`` are (src, place, lon, lat, tags), ``squares`` (src, place, lon, lat, km2, tags);
    place counts from 1 within a source and kind. Nodes are points, then corners of squares.
    """
    was = before.select("src", F.col("way_at").alias("had_way"), F.col("relation_at").alias("had_relation"))
    due = after.join(was, "src", "left")
    count = points.groupBy("src").agg(F.count("*").alias("n_points"))
    due = due.join(count, "src", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))
    nodes, ways = due.where("way_at IS NOT NULL AND had_way IS NULL"), due.where("relation_at IS NOT NULL AND had_relation IS NULL")
    none = F.lit(None).cast("array<long>")
    point = points.join(nodes, "src").select(F.col("place").cast("int").alias("part"), "src", F.col("way_at").alias("seq"), F.lit("n").alias("t"), (F.col("base_n") + F.col("place")).alias("id"), "lon", "lat", none.alias("nodes"), "tags")
    first = F.col("n_points") + (F.col("place") - 1) * 4
    corner = squares.join(nodes, "src").select("src", "way_at", "base_n", first.alias("first"), F.posexplode(square_around(F.col("lon"), F.col("lat"), F.col("km2"))).alias("k", "c"))
    corner = corner.select((F.col("first") + F.col("k") + 1).cast("int").alias("part"), "src", F.col("way_at").alias("seq"), F.lit("n").alias("t"), (F.col("base_n") + F.col("first") + F.col("k") + 1).alias("id"), "c.lon", "c.lat", none.alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    ring = F.transform(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 1)]), lambda i: F.col("base_n") + first + i)
    # Ways come after nodes that become due at the same row.
    way = squares.join(ways, "src").select((F.lit(1 << 30) + F.col("place")).cast("int").alias("part"), "src", F.col("relation_at").alias("seq"), F.lit("w").alias("t"), (F.col("base_w") + F.col("place")).alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), ring.alias("nodes"), "tags")
    return point.unionByName(corner).unionByName(way)


def _passed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows that have passed, with the changes (t, id, changes) of their tags."""
    joined = rows.where(F.col("t") != END).join(changes, ["t", "id"], "left")
    tags = F.when(F.col("changes").isNull(), F.col("tags")).otherwise(overlaid(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.col("changes")))
    return joined.select(F.lit(PASSED).alias("part"), "src", "seq", "t", "id", "lon", "lat", "nodes", tags.alias("tags"))


def injected(rows: DataFrame, points: DataFrame, squares: DataFrame, changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A whole extract, or what a batch adds to ``state``: rows (OUT), whose order is (src, seq, part)."""
    before = rows.sparkSession.createDataFrame([], STATE) if state is None else state
    return _passed(rows, changes).unionByName(made(before, advanced(before, rows), points, squares))


def extract_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """An extract as a stream of Parquet files, so many at a time, in order of their appearance."""
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(path)


def inject_stream(stream: DataFrame, points: DataFrame, squares: DataFrame, changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream of an extract with what is made to ``path``: ``out/batch=N`` and ``state/vN`` for each micro-batch.

    Both are written over when a batch is run again after a failure, from the state of the
    batch before it, so a restart gives the same rows.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{path}/state/v{number - 1}") if number else spark.createDataFrame([], STATE)
        rows = batch.persist()
        try:
            injected(rows, points, squares, changes, before).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
            advanced(before, rows).write.mode("overwrite").parquet(f"{path}/state/v{number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_injected(spark: SparkSession, path: str) -> DataFrame:
    """All that a stream has written, as rows (OUT)."""
    return spark.read.schema(OUT + ", batch int").parquet(f"{path}/out").drop("batch")
