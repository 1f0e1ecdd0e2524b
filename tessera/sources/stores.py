"""GeoPackages (tile and county tables) and chunked array stores (embedding cubes)."""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import EMPTY_FRAME, get_text, put_text, write_files

RING = "array<struct<x: double, y: double>>"
RINGS = f"array<{RING}>"


def _wkb_rings(blob: bytes, at: int) -> tuple[list[list[dict[str, float]]], int]:
    """(all rings, the place behind) of the polygon or multipolygon at ``at``."""
    order = "<" if blob[at] else ">"
    kind, n = struct.unpack_from(order + "II", blob, at + 1)
    at, rings, dims = at + 9, [], 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    if kind % 1000 not in (3, 6):
        raise ValueError(f"geometry of type {kind}, not a polygon")
    for _ in range(n):
        if kind % 1000 == 6:
            more, at = _wkb_rings(blob, at)
            rings += more
            continue
        points = struct.unpack_from(order + "I", blob, at)[0]
        v = struct.unpack_from(f"{order}{dims * points}d", blob, at + 4)
        rings.append([{"x": v[dims * i], "y": v[dims * i + 1]} for i in range(points)])
        at += 4 + 8 * dims * points
    return rings, at


def _geometry(blob: bytes | None) -> list[list[dict[str, float]]] | None:
    """All rings of a GeoPackage geometry: holes and parts; null for none."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return _wkb_rings(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])[0]


def _signed(ring) -> float:
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, [*ring[1:], ring[0]]))


def _holds(ring, p) -> bool:
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]]):
        if (a["y"] > p["y"]) != (b["y"] > p["y"]) and p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]:
            inside = not inside
    return inside


def _blob(rings, srs: int) -> bytes:
    """A polygon, or a multipolygon of several outer rings; rings that run the other way than the
    first are holes of the outer ring that holds them."""
    one = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in r)
    outer = [r for r in rings if (_signed(r) > 0) == (_signed(rings[0]) > 0)]
    parts = [[r] for r in outer]
    for hole in (r for r in rings if (_signed(r) > 0) != (_signed(rings[0]) > 0)):
        parts[next((k for k, r in enumerate(outer) if _holds(r, hole[0])), 0)].append(hole)
    body = [struct.pack("<BII", 1, 3, len(p)) + b"".join(map(one, p)) for p in parts]
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + (body[0] if len(body) == 1 else struct.pack("<BII", 1, 6, len(body)) + b"".join(body))


def read_geopackage(spark: SparkSession, path: str, table: str, schema: str, geometry: str = "geom", rings: bool = False) -> DataFrame:
    """Rows of a feature table: the columns of ``schema`` (a DDL string) and ``ring``, the ring of the
    geometry, or with ``rings`` all of them (holes and parts). Without it a geometry of several rings
    fails the read, as does one that is no polygon. Files are opened in memory, so any store Spark
    reads will do."""
    wanted = T._parse_datatype_string(schema).fieldNames()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("content")
    sql = f'select {", ".join(chr(34) + c + chr(34) for c in [*wanted, geometry])} from "{table}"'

    def shape(blob: bytes | None):
        found = _geometry(blob)
        if rings or found is None:
            return found
        if len(found) != 1:
            raise ValueError(f"a geometry has {len(found)} rings: read it with rings=True")
        return found[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                rows = db.execute(sql)
                while block := rows.fetchmany(1000):
                    yield pd.DataFrame([(*r[:-1], shape(r[-1])) for r in block], columns=[*wanted, "rings" if rings else "ring"])

    return files.mapInPandas(run, f"{schema}, rings {RINGS}" if rings else f"{schema}, ring {RING}")


def build_geopackage(df: DataFrame, table: str, srs: int = 4326, max_rows: int = 1_000_000) -> bytes:
    """A GeoPackage of a small table with a ``ring`` or ``rings`` column; refuses more than
    ``max_rows``, as one file of that kind is written in one place."""
    if (n := df.count()) > max_rows:
        raise ValueError(f"{n} rows are too many for one file")
    names = [c for c in df.columns if c not in ("ring", "rings")]
    shape = (lambda r: r["rings"]) if "rings" in df.columns else lambda r: [r["ring"]]
    db = sqlite3.connect(":memory:")
    db.execute("pragma application_id = 1196444487")
    db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
    db.execute("insert into gpkg_contents values (?, 'features', ?, ?)", (table, table, srs))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (table, srs))
    db.execute(f'create table "{table}" (fid integer primary key, {", ".join(chr(34) + c + chr(34) for c in names)}, geom blob)')
    marks = ", ".join("?" * (len(names) + 1))
    db.executemany(f'insert into "{table}" ({", ".join(chr(34) + c + chr(34) for c in names)}, geom) values ({marks})', ((*(r[c] for c in names), _blob(shape(r), srs)) for r in df.toLocalIterator()))
    db.commit()
    return db.serialize()


def _unpacked(raw: bytes, how: str | None) -> bytes:
    if how is None:
        return raw
    if how in ("zlib", "gzip"):
        return zlib.decompressobj(47).decompress(raw)
    if how == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"no decoder for {how}")


@dataclass
class Layout:
    """How an array of a store is cut and packed."""

    shape: list[int]
    chunks: list[int]
    dtype: str
    packed: str | None
    folder: str
    separator: str


# Data types of version 3 by numpy's names.
_KINDS = {"bool": "|b1", "int8": "|i1", "uint8": "|u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "int64": "<i8", "float16": "<f2", "float32": "<f4", "float64": "<f8"}


def _layout(spark: SparkSession, path: str, array: str) -> Layout:
    """Of version 3 (zarr.json) or 2 (.zarray)."""
    if (text := get_text(spark, f"{path}/{array}/zarr.json")) is not None:
        head = json.loads(text)
        if head.get("zarr_format") != 3 or head["chunk_grid"]["name"] != "regular" or head["data_type"] not in _KINDS:
            raise ValueError(f"{array}: not a regular array of numbers of version 3")
        codecs = {c["name"]: c.get("configuration", {}) for c in head["codecs"]}
        if unknown := set(codecs) - {"bytes", "zstd", "gzip", "crc32c"} | ({"crc32c"} & set(codecs)):
            raise ValueError(f"{array}: no decoder for {', '.join(sorted(unknown))}")
        kind = _KINDS[head["data_type"]]
        if codecs["bytes"].get("endian") == "big":
            kind = kind.replace("<", ">")
        key = head.get("chunk_key_encoding", {"name": "default"})
        separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
        folder = f"{path}/{array}/c" if key["name"] == "default" else f"{path}/{array}"
        return Layout(head["shape"], head["chunk_grid"]["configuration"]["chunk_shape"], kind, next((c for c in ("zstd", "gzip") if c in codecs), None), folder, separator)
    if (text := get_text(spark, f"{path}/{array}/.zarray")) is None:
        raise FileNotFoundError(f"no array {array} in {path}")
    head = json.loads(text)
    if head.get("order", "C") != "C" or head.get("filters"):
        raise ValueError(f"{array}: another order, or filters")
    return Layout(head["shape"], head["chunks"], head["dtype"], (head["compressor"] or {}).get("id"), f"{path}/{array}", head.get("dimension_separator", "."))


def _chunk_files(spark: SparkSession, at: Layout) -> DataFrame:
    """(key, content): the key's parts are joined by dots, whatever the store joins them by."""
    n, base = len(at.shape), at.folder.rstrip("/").rpartition("/")[2]
    pattern = f"{re.escape(base)}/" + re.escape(at.separator).join([r"([0-9]+)"] * n) + "$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at.folder)
    key = F.array(*(F.regexp_extract("path", pattern, i + 1) for i in range(n)))
    return files.where(F.col("path").rlike(pattern)).select(F.array_join(key, ".").alias("key"), "content")


def read_cube(spark: SparkSession, path: str, array: str = "embedding", mask: str = "mask") -> DataFrame:
    """Rows (tile, window, embedding) of a chunked store (version 3 or 2) with an array (tile, window,
    dim) and a mask (tile, window), however either is cut: the cells whose mask is true.

    A chunk is a row for a task; chunks that were never written have no rows, and a chunk of the mask
    that was never written is false. Vectors meet their mask by tile and window."""
    made, flags = _layout(spark, path, array), _layout(spark, path, mask)
    if made.chunks[2] != made.shape[2] or made.shape[:2] != flags.shape:
        raise ValueError("vectors are cut into several chunks, or the mask is of another shape")

    def cells(of: Layout):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ct, cw = of.chunks[:2]
            for part in parts:
                for key, data in part[["key", "content"]].itertuples(index=False):
                    t0, w0 = (int(k) for k in key.split(".")[:2])
                    x = np.frombuffer(_unpacked(bytes(data), of.packed), of.dtype, int(np.prod(of.chunks))).reshape(of.chunks)
                    x = x[: of.shape[0] - t0 * ct, : of.shape[1] - w0 * cw]
                    t, w = np.indices(x.shape[:2]).reshape(2, -1)
                    if x.ndim == 2:
                        t, w = t[x.ravel() != 0], w[x.ravel() != 0]
                    for lo in range(0, len(t), 1000):
                        a, b = t[lo : lo + 1000], w[lo : lo + 1000]
                        out = {"tile": t0 * ct + a, "window": w0 * cw + b}
                        yield pd.DataFrame(out if x.ndim == 2 else out | {"embedding": list(x[a, b].astype(np.float32))})

        return run

    vectors = _chunk_files(spark, made).mapInPandas(cells(made), "tile long, window long, embedding array<float>")
    known = _chunk_files(spark, flags).mapInPandas(cells(flags), "tile long, window long")
    return vectors.join(known, ["tile", "window"], "left_semi")


def _v3(shape: list[int], chunks: list[int], kind: str) -> str:
    body = {"name": "bytes"} if kind == "bool" else {"name": "bytes", "configuration": {"endian": "little"}}
    return json.dumps({
        "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "fill_value": False if kind == "bool" else 0.0, "attributes": {}, "storage_transformers": [],
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [body, {"name": "zstd", "configuration": {"level": 0, "checksum": False}}],
    })


def open_cube(spark: SparkSession, path: str, tiles: int, windows: int, dim: int = 1024, windows_a_chunk: int = 19, tiles_a_chunk: int | None = None) -> None:
    """Creates a store of version 3 with its arrays ``embedding`` (a chunk for each window) and ``mask``
    (a chunk for each year), unless it is there; one of another shape is refused."""
    per = tiles_a_chunk or max(1, tiles)
    for name, shape, chunks, kind in (("embedding", [tiles, windows, dim], [per, 1, dim], "float32"), ("mask", [tiles, windows], [per, windows_a_chunk], "bool")):
        if (text := get_text(spark, f"{path}/{name}/zarr.json")) is None:
            put_text(spark, f"{path}/{name}/zarr.json", _v3(shape, chunks, kind))
        elif json.loads(text)["shape"] != shape:
            raise ValueError(f"{path} has {name} of shape {json.loads(text)['shape']}")
    if get_text(spark, f"{path}/zarr.json") is None:
        put_text(spark, f"{path}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}))


def write_cube(cells: DataFrame, path: str) -> int:
    """Writes rows (tile, window, embedding) into an open store; a null embedding is no cell. The
    chunks of ``embedding`` that have rows (a window's tiles) are replaced, with their cells of the
    mask; all other cells stay. A chunk is built in one task, and its size is the store's. Returns the
    number of files written."""
    import zstandard

    spark = cells.sparkSession
    made, flags = _layout(spark, path, "embedding"), _layout(spark, path, "mask")
    cells = cells.where("embedding is not null").select(F.col("tile").cast("long"), F.col("window").cast("long"), "embedding")

    def chunk(of: Layout, name: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            x = np.zeros(of.chunks, of.dtype)
            t, w = part["tile"].to_numpy(), part["window"].to_numpy()
            at = t // of.chunks[0], w // of.chunks[1]
            x[t % of.chunks[0], w % of.chunks[1]] = np.stack(part["embedding"].to_numpy()) if x.ndim == 3 else True
            key = "/".join(map(str, [at[0][0], at[1][0], *[0] * (x.ndim - 2)]))
            return pd.DataFrame([(f"{name}/c/{key}", zstandard.ZstdCompressor(level=3).compress(x.tobytes()))], columns=["name", "content"])

        return run

    def dealt(df: DataFrame, of: Layout, name: str) -> DataFrame:
        return df.groupBy(F.floor(F.col("tile") / of.chunks[0]), F.floor(F.col("window") / of.chunks[1])).applyInPandas(chunk(of, name), "name string, content binary")

    try:
        old = _chunk_files(spark, flags)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    seen = cells.select("tile", "window")
    if old is not None:
        layout = flags

        def true_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for key, data in part[["key", "content"]].itertuples(index=False):
                    t0, w0 = (int(k) for k in key.split("."))
                    x = np.frombuffer(_unpacked(bytes(data), layout.packed), layout.dtype, int(np.prod(layout.chunks))).reshape(layout.chunks)
                    t, w = np.nonzero(x)
                    yield pd.DataFrame({"tile": t0 * layout.chunks[0] + t, "window": w0 * layout.chunks[1] + w})

        before, chunk_of = old.mapInPandas(true_cells, "tile long, window long"), lambda of: [F.floor(F.col(c) / n).alias(f"_{c}") for c, n in zip(("tile", "window"), of.chunks)]
        for of, how in ((flags, "left_semi"), (made, "left_anti")):  # of masks that change, cells whose vectors stay
            before = before.select("tile", "window", *chunk_of(of)).join(seen.select(*chunk_of(of)).distinct(), ["_tile", "_window"], how).select("tile", "window")
        seen = seen.unionByName(before).distinct()
    files = dealt(cells, made, "embedding").unionByName(dealt(seen, flags, "mask"))
    return write_files(files, path, end=EMPTY_FRAME)
