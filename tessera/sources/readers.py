"""Readers and writers of the stages' tables.

Rasters and vectors are kept as Parquet: pixels as rows, geometry as arrays of points. What comes
in other forms is decoded where it can be without native libraries (shapefile polygons, ledgers,
metadata, XML replies, listings); downloads and services are outside this library.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import tuesday_on_or_before

POLYGON_SCHEMA = "path string, record int, ring array<struct<x: double, y: double>>, rings array<array<struct<x: double, y: double>>>, attributes map<string, string>"


def partitioned(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Composites laid out by (sensor, year, window_index); a year reads only its partitions. A
    corrupt file fails the read; ``corrupt_files`` names it."""
    df = spark.read.parquet(path)
    return df if year is None else df.where(F.col("year") == year)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("sensor", "year", "window_index")) -> None:
    """Idempotent: only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def usable_files(spark: SparkSession, path: str, glob: str = "*", min_bytes: int = 1024) -> DataFrame:
    """Files below a path that are not cut off (path, length), by metadata alone; content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).where(F.col("length") > min_bytes).select("path", "length")


def corrupt_files(spark: SparkSession, path: str, min_bytes: int = 12) -> DataFrame:
    """The quarantine table of a folder of Parquet files: (path, length, error) of those that are
    too short, or do not begin and end as such files do. Files of no bytes hold no rows and are not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    mark = F.lit(b"PAR1")
    head, tail = F.substring("content", 1, 4), F.substring("content", -4, 4)
    error = F.when(F.col("length") < min_bytes, "too short").when(head != mark, "no head").when(tail != mark, "cut off")
    return files.select("path", "length", error.alias("error")).where("error is not null")


def first_file(files: DataFrame, by: list[str]) -> DataFrame:
    """One file a key: the first by path."""
    return files.groupBy(*by).agg(F.min("path").alias("path"))


def scene_search(catalogue: DataFrame, box: tuple[float, float, float, float], start: str, end: str, max_cloud: float | None = None, mode: str | None = None, polarisations: tuple[str, ...] = ()) -> DataFrame:
    """Scenes whose box meets ``box``, of start <= ts < end, and below the cloud cover; radar
    scenes by instrument mode and polarisations. All are predicates that reach the scan."""
    x0, y0, x1, y1 = box
    out = catalogue.where((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0)).where((F.col("ts") >= start) & (F.col("ts") < end))
    if max_cloud is not None:
        out = out.where(F.col("cloud_cover") < max_cloud)
    if mode is not None:
        out = out.where(F.col("mode") == mode)
    for p in polarisations:
        out = out.where(F.array_contains("polarisation", p))
    return out


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ledger, empty if there is none yet."""
    try:
        return spark.read.csv(path, schema=schema, header=True).na.fill("")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(document: DataFrame, path: str) -> None:
    """One row, one string column: a JSON document."""
    document.coalesce(1).write.mode("overwrite").text(path)


def encoder_metadata(spark: SparkSession, text: str) -> DataFrame:
    """sensor -> bands -> {mean, std, wavelength} -> band, and gsd, as JSON (or YAML, where a
    parser is installed): rows (sensor, band, mean, std, wavelength, gsd)."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    rows = [(s, b, float(m["bands"]["mean"][b]), float(m["bands"]["std"][b]), float(m["bands"]["wavelength"][b]), float(m["gsd"])) for s, m in found.items() for b in m["bands"]["mean"]]
    return spark.createDataFrame(rows, "sensor string, band string, mean double, std double, wavelength double, gsd double")


def xml_value(document: Column, path: str) -> Column:
    """The text of an element of an XML reply; empty if it is not there."""
    return F.xpath_string(document, F.lit(path))


def listing_ids(document: Column) -> Column:
    """Ids of the folders in a JSON listing."""
    return F.transform(F.filter(F.from_json(document, "array<struct<ID: string, Name: string, IsDir: boolean>>"), lambda x: x["IsDir"]), lambda x: x["ID"])


def _dbf_rows(data: bytes) -> list[dict[str, str]]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, pos = data[head + i * size : head + (i + 1) * size], 1
        values = {}
        for name, width in fields:
            values[name] = row[pos : pos + width].decode("latin-1").strip()
            pos += width
        out.append(values)
    return out


def _shp_records(data: bytes) -> Iterator[tuple[int, list[list[dict[str, float]]]]]:
    """(record, rings) of each polygon: all its parts, outer rings and holes alike."""
    at = 100
    while at + 12 <= len(data):
        record, words = struct.unpack_from(">II", data, at)
        kind = struct.unpack_from("<I", data, at + 8)[0]
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<II", data, at + 44)
            first = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            yield record, [[{"x": xy[2 * k], "y": xy[2 * k + 1]} for k in range(s, e)] for s, e in zip(first, first[1:])]
        elif kind:
            raise ValueError(f"record {record} is of shape type {kind}, not a polygon")
        at += 8 + 2 * words


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of the shapefiles below a path: a row a record, with all its ``rings`` (holes and
    parts) and its attributes; ``ring`` is the only ring of a record that has one, else null. A
    file's .shp and .dbf meet by their stem; a missing .dbf leaves no attributes; records without a
    shape are left out, other shapes than polygons fail the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$"))
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    pairs = files.groupBy(stem.alias("path")).agg(F.max(F.when(F.lower("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.lower("path").endswith(".dbf"), F.col("content"))).alias("dbf")).where("shp is not null")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, shp, dbf in part[["path", "shp", "dbf"]].itertuples(index=False):
                attributes = _dbf_rows(bytes(dbf)) if dbf is not None else []
                rows = [(path, record, rings[0] if len(rings) == 1 else None, rings, attributes[record - 1] if record <= len(attributes) else {}) for record, rings in _shp_records(bytes(shp))]
                for lo in range(0, len(rows), 100):
                    yield pd.DataFrame(rows[lo : lo + 100], columns=["path", "record", "ring", "rings", "attributes"])

    return pairs.mapInPandas(run, POLYGON_SCHEMA)


def drought_snapshots(polygons: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (with start_date) and the drought polygons of the Tuesday on or before each: a row for
    each polygon, one with nulls where that snapshot is missing, so that a window whose snapshot
    could not be had is told from one without drought. ``polygons``: snapshot_date and more."""
    wanted = windows.withColumn("usdm_date", tuesday_on_or_before(F.col("start_date")))
    there = polygons.select("snapshot_date").distinct().withColumn("has_snapshot", F.lit(True))
    dated = wanted.join(there, wanted["usdm_date"] == there["snapshot_date"], "left").drop("snapshot_date").withColumn("has_snapshot", F.coalesce("has_snapshot", F.lit(False)))
    return dated.join(polygons, dated["usdm_date"] == polygons["snapshot_date"], "left").drop("snapshot_date")


def strip_suffix(name: Column, suffix: str) -> Column:
    """The name without the suffix, once, if it ends with it."""
    return F.when(name.endswith(suffix) & F.lit(bool(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def attribute(column: Column, *names: str) -> Column:
    """The first of some names that an attribute map has (a drought class is DM, dm, Class ...)."""
    return F.coalesce(*(F.element_at(column, n) for n in names))
