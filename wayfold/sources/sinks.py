"""Files for others to read: JSON in order, GeoJSON, Markdown, and replacement in one step."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """A file is no longer what it was when it was read."""


def digest(path: str) -> str:
    """The SHA-256 of a file, or ``missing``."""
    try:
        with open(path, "rb") as f:
            return hashlib.sha256(f.read()).hexdigest()
    except FileNotFoundError:
        return "missing"


def replace_file(path: str, data: bytes | str, expect: str | None = None) -> None:
    """Replace a driver-side file so that readers see all of the old or all of the new; refuses if its digest is not ``expect``."""
    data = data.encode() if isinstance(data, str) else data
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if expect is not None and digest(path) != expect:
            raise Conflict(path)
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(part)
        raise


@contextlib.contextmanager
def locked(path: str) -> Iterator[None]:
    """An exclusive lock, refused at once if another holds it."""
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise Conflict(f"{path} is locked") from e
        yield


def type_order(t: Column) -> Column:
    """Nodes, then ways, then relations."""
    return F.array_position(F.array(F.lit("n"), F.lit("w"), F.lit("r")), t)


def write_json_in_order(rows: DataFrame, path: str, *order: Column | str) -> None:
    """JSON lines in global order, null fields left out; a file for each range."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def rounded(ring: Column, digits: int = 5) -> Column:
    return F.transform(ring, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))


def features(areas: DataFrame, ring: str, *properties: str) -> DataFrame:
    """One GeoJSON feature of each row, as ``value``; write with ``.write.text``."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(rounded(F.col(ring))).alias("coordinates"))
    return areas.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def read_features(text: DataFrame, value: str = "value", properties: str = "map<string,string>") -> DataFrame:
    """Rows (properties, polygon, ring) of a feature collection: each polygon of each feature, and its outer ring."""
    schema = f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:string>>>"
    f = text.select(F.explode(F.from_json(value, schema)["features"]).alias("f")).select("f.properties", "f.geometry.*")
    rings = "array<array<array<double>>>"
    many = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", rings))).otherwise(F.from_json("coordinates", f"array<{rings}>"))
    each = f.select("properties", F.posexplode(many).alias("polygon", "rings"))
    return each.select("properties", "polygon", F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("ring"))


def markdown(rows: list[tuple], header: list[str]) -> str:
    """A Markdown table, bars in cells escaped."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(header), "|" + "---|" * len(header), *map(line, rows)]) + "\n"
