"""A decision log as a stream: each micro-batch is merged into the table of standing lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a log folder, in order of their appearance."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def merge_latest(state: DataFrame | None, batch: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The last line of each key of a state and a batch. A batch that comes twice changes nothing."""
    both = batch if state is None else state.unionByName(batch)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(line).desc()))).where("__n = 1").drop("__n")


def maintain_latest(stream: DataFrame, path: str, keys: list[str], line: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the standing lines under ``path``, a folder for each version named by batch.

    A version is written from the one before it and the batch, so a batch that is run again
    after a failure overwrites its own version with the same rows.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merge_latest(before, batch, keys, line).write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def overlay_stream(stream: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Records of a stream with the tags of a static table (keys, changes) put over theirs."""
    from ..functions.tags import overlaid

    joined = stream.join(changes.select(*keys, "changes"), keys, "left")
    return joined.withColumn("tags", F.when(F.col("changes").isNull(), F.col("tags")).otherwise(overlaid(F.col("tags"), F.col("changes")))).drop("changes")
