"""Text tables: strict CSV with line numbers, JSON lines with a header, decision logs, lock files."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode a fresh local folder is set where the session has none, as in tests; on a
    cluster, whose executors would not see such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage: a lost executor costs a reread, not a recomputation, and what
    follows sees the true size of the table.
    """
    path = f"{shared_dir(df.sparkSession)}/wayfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class TableError(ValueError):
    """All problems of a table at once."""

    def __init__(self, problems: list[tuple[int, str]]):
        super().__init__("; ".join(f"line {n}: {what}" for n, what in problems))
        self.problems = problems


def parse_csv(text: str, required: tuple[str, ...] = ()) -> tuple[list[str], list[tuple[int, dict[str, str]]], list[tuple[int, str]]]:
    """Header, rows (line, cells) and problems of a CSV text.

    A byte-order mark is skipped, blank lines are left out, cells are stripped, and ``line``
    is where a row begins. Problems: a table split by semicolons, repeated or missing
    columns, rows of another width.
    """
    reader = csv.reader(io.StringIO(text.removeprefix("\ufeff")))
    header = [c.strip() for c in next(reader, [])]
    problems: list[tuple[int, str]] = []
    if len(header) == 1 and ";" in header[0]:
        return header, [], [(1, "columns are separated by semicolons")]
    if twice := sorted({c for c in header if header.count(c) > 1}):
        problems.append((1, f"repeated columns: {', '.join(twice)}"))
    if missing := [c for c in required if c not in header]:
        problems.append((1, f"missing columns: {', '.join(missing)}"))
    rows, start = [], reader.line_num + 1
    for cells in reader:
        line, start = start, reader.line_num + 1
        if not any(c.strip() for c in cells):
            continue
        if len(cells) != len(header):
            problems.append((line, f"{len(cells)} cells, {len(header)} columns"))
            continue
        rows.append((line, dict(zip(header, (c.strip() for c in cells), strict=True))))
    return header, rows, problems


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A hand-kept table as strings with ``line``; raises TableError with every problem.

    The file is read by Spark's own reader and parsed on the driver, as such lists are small
    and their line numbers matter; for large files use ``spark.read.csv``.
    """
    text = spark.read.text(path, wholetext=True).first()
    header, rows, problems = parse_csv(text[0] if text else "", required)
    if problems:
        raise TableError(problems)
    schema = T.StructType([T.StructField("line", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in header]])
    return spark.createDataFrame([(n, *[r[c] for c in header]) for n, r in rows], schema)


def write_csv(header: list[str], rows: list[dict[str, str]]) -> str:
    out = io.StringIO()
    writer = csv.DictWriter(out, header, lineterminator="\n", extrasaction="ignore")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


OBJECT = "src string, t string, id bigint, lon double, lat double, tags map<string,string>"


def read_records(spark: SparkSession, path: str, schema: str = OBJECT, header: str = "extracts") -> DataFrame:
    """JSON lines without the header line, which is the one that has ``header``."""
    return spark.read.schema(f"{schema}, {header} string").json(path).where(F.col(header).isNull()).drop(header)


def read_header(spark: SparkSession, path: str, header: str = "extracts") -> str:
    found = spark.read.text(path).where(F.get_json_object("value", f"$.{header}").isNotNull()).limit(1).collect()
    if not found:
        raise ValueError(f"{path} has no header line")
    return spark.createDataFrame(found).select(F.get_json_object("value", f"$.{header}")).first()[0]


LOG = "id string, action string, ref string"


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a log (line, value) with their fields, and ``bad`` for what is no JSON object. Blank lines are left out."""
    parsed = lines.where(F.trim(value) != "").withColumn("j", F.from_json(value, LOG, {"mode": "PERMISSIVE"}))
    bad = ~F.coalesce(F.trim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.lit(False))
    return parsed.select(*[c for c in lines.columns if c != value], "j.*", bad.alias("bad"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A decision log (one file) with line numbers: the file's lines are exploded with their places."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("n", "value")).select((F.col("n") + 1).alias("line"), "value")
    return parse_log(lines)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, value) of ``KEY=value`` lines; comments and other lines are left out."""
    pair = lambda i: F.regexp_extract("value", r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$", i)
    return spark.read.text(path).select(pair(1).alias("key"), F.trim(pair(2)).alias("value")).where("key <> ''")


def first_of_each(entries: DataFrame, key: str, place: str) -> DataFrame:
    """Entries with a key, the first of each in order of place."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(place)
    return entries.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cached_lookup(names: DataFrame, cache: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(known, todo): names (name) with the cache's value, negative answers included, and names it lacks. New answers go before the cache's."""
    if found is not None:
        cache = found.unionByName(cache.join(found.select("name"), "name", "left_anti"))
    wanted = names.select("name").distinct()
    return wanted.join(cache, "name"), wanted.join(cache.select("name"), "name", "left_anti")
