"""GeoTIFF composites as pixel blocks, decoded in tasks with numpy.

Classic and BigTIFF, strips and tiles, uncompressed, deflate and LZW, horizontal differencing, all
whole and floating sample types, chunky or planar bands. A block is a row; a file's blocks can be
dealt out again by (path, block). Files are read whole by their task, as the binary source gives
them, so a file's size bounds a task's memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

SCHEMA = "path string, band int, row int, col int, height int, width int, x0 double, y0 double, pixel double, values array<double>"

# Fixed values of the format: sizes and codes of the field types, the tags used, and sample formats.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT, PIXEL_SCALE, TIE_POINT = 322, 323, 324, 325, 339, 33550, 33922
KIND = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)


class Unsupported(ValueError):
    """A file that is whole, but of a kind that is not decoded here."""


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    out = {}
    for _ in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
        size, code = FIELD.get(kind, (1, "B"))
        place, room = (at + 12, 8) if big else (at + 8, 4)
        if size * count > room:
            place = struct.unpack_from(order + ("Q" if big else "I"), data, place)[0]
        out[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
        at += 20 if big else 12
    return order, out


def _lzw(data: bytes) -> bytes:
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits & (1 << width) - 1
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _lzw_packed(data: bytes) -> bytes:
    """The same, packed: codes from 9 to 12 bits, cleared when the table is full."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = 258 + len(table)
        n = 258 + len(table)
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n >= 4094:
            put(256)
            table, width = {}, 9
        word = longer[-1:]
    if word:
        put(table[word] if len(word) > 1 else word[0])
        n = 259 + len(table)
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 0xFF)
    return bytes(out)


def blocks(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band from 1, row, column, pixels) of each strip or tile of the first image, cut to it."""
    order, tag = _tags(data)
    one = lambda t, default=1: tag.get(t, (default,))[0]
    width, height, bands, planar = one(WIDTH), one(HEIGHT), one(BANDS), one(PLANAR) == 2
    tiled = TILE_OFFSETS in tag
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    across, down, each = -(-width // bw), -(-height // bh), 1 if planar else bands
    how, predictor = one(COMPRESSION), one(PREDICTOR)
    if how not in (*PLAIN, *LZW, *DEFLATE):
        raise Unsupported(f"compression {how}")
    if predictor not in (1, 2, 3) or one(FORMAT) not in KIND or one(BITS) not in (8, 16, 32, 64) or len(set(tag.get(BITS, (1,)))) > 1:
        raise Unsupported(f"predictor {predictor}, sample format {one(FORMAT)}, bits {tag.get(BITS)}")
    kind = np.dtype(f"{order}{KIND[one(FORMAT)]}{one(BITS) // 8}")
    if predictor == 3 and kind.kind != "f":
        raise Unsupported("predictor 3 of whole numbers")
    places = zip(tag[TILE_OFFSETS if tiled else STRIP_OFFSETS], tag[TILE_SIZES if tiled else STRIP_SIZES])
    for k, (at, size) in enumerate(places):
        if at + size > len(data):
            raise ValueError(f"block {k} is cut off")
        raw = data[at : at + size]
        raw = zlib.decompress(raw) if how in DEFLATE else _lzw(raw) if how in LZW else raw
        plane, j = divmod(k, across * down)
        row, col = j // across * bh, j % across * bw
        rows = bh if tiled else min(bh, height - row)
        if len(raw) < rows * bw * each * kind.itemsize:
            raise ValueError(f"block {k} has {len(raw)} bytes")
        if predictor == 3:  # a row's bytes by significance, greatest first, differenced by sample
            x = np.frombuffer(raw, np.uint8, rows * bw * each * kind.itemsize).reshape(rows, -1, each)
            x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, bw * each)
            x = np.ascontiguousarray(x.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, bw, each)
        else:
            x = np.frombuffer(raw, kind, rows * bw * each).reshape(rows, bw, each)
        if predictor == 2:
            x = np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("="))
        x = x[: height - row, : width - col]
        for b in range(each):
            yield plane + 1 if planar else b + 1, row, col, x[:, :, b]


def grid(data: bytes) -> tuple[float, float, float]:
    """(x of the left edge, y of the top edge, pixel size); pixels without a georeference."""
    _, tag = _tags(data)
    if PIXEL_SCALE not in tag or TIE_POINT not in tag:
        return 0.0, 0.0, 1.0
    size, tie = tag[PIXEL_SCALE][0], tag[TIE_POINT]
    return tie[3] - tie[0] * size, tie[4] + tie[1] * size, size


def read_geotiff(spark: SparkSession, path: str, bands: tuple[int, ...] = (), strict: bool = False, errors: bool = False, glob: str = "*.tif") -> DataFrame:
    """A row for each block and band. ``values`` are the block's pixels, row by row.

    A file of a kind that is not decoded here (another compression, predictor or sample format) fails
    the read. A damaged file has no rows, or fails the read if ``strict``; with ``errors`` there is a
    column more, ``error``, and a damaged file, or one not decoded, has one row that tells why.
    ``quarantine`` gives just these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    names = ["path", "band", "row", "col", "height", "width", "x0", "y0", "pixel", "values"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in part.itertuples(index=False):
                try:
                    data = bytes(content)
                    x0, y0, size = grid(data)
                    rows = [(name, b, r, c, *x.shape, x0, y0, size, x.astype(float).ravel()) for b, r, c, x in blocks(data) if not bands or b in bands]
                except (KeyError, ValueError, IndexError, struct.error, zlib.error) as e:
                    if strict or (isinstance(e, Unsupported) and not errors):
                        raise
                    if errors:
                        yield pd.DataFrame([(name, *[None] * 9, f"{type(e).__name__}: {e}")], columns=[*names, "error"])
                    continue
                for lo in range(0, len(rows), 16):
                    out = pd.DataFrame(rows[lo : lo + 16], columns=names)
                    yield out.assign(error=None) if errors else out

    return files.mapInPandas(run, SCHEMA + (", error string" if errors else ""))


def quarantine(spark: SparkSession, path: str, glob: str = "*.tif", min_bytes: int = 1024) -> DataFrame:
    """(path, error) of the files below a path that ``read_geotiff`` gives no pixels of, and of those
    too short to be a composite."""
    short = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= min_bytes).select("path", F.lit("too short").alias("error"))
    bad = read_geotiff(spark, path, errors=True, glob=glob).where("error is not null").select("path", "error")
    return bad.unionByName(short).groupBy("path").agg(F.max("error").alias("error"))


def pixels(blocks_df: DataFrame) -> DataFrame:
    """A row for each pixel of read_geotiff's blocks: path, band, row, col, and its centre x, y."""
    flat = blocks_df.select("path", "band", F.col("row").alias("_r"), F.col("col").alias("_c"), "width", "x0", "y0", "pixel", F.posexplode("values").alias("_i", "value"))
    row, col = F.col("_r") + F.expr("_i div width").cast("int"), F.col("_c") + F.col("_i") % F.col("width")
    return flat.select("path", "band", row.alias("row"), col.alias("col"), (F.col("x0") + (col + 0.5) * F.col("pixel")).alias("x"), (F.col("y0") - (row + 0.5) * F.col("pixel")).alias("y"), "value")


def build_geotiff(bands: np.ndarray, x0: float = 0.0, y0: float = 0.0, pixel: float = 1.0, tile: int = 256, deflate: bool = True, lzw: bool = False) -> bytes:
    """A tiled planar BigTIFF of (band, row, column) pixels, packed by LZW, deflate or not."""
    n, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    body, places = bytearray(), []
    for b in range(n):
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                x = np.zeros((tile, tile), bands.dtype.newbyteorder("<"))
                part = bands[b, r : r + tile, c : c + tile]
                x[: part.shape[0], : part.shape[1]] = part
                raw = _lzw_packed(x.tobytes()) if lzw else zlib.compress(x.tobytes()) if deflate else x.tobytes()
                places.append((16 + len(body), len(raw)))
                body += raw
    how = LZW[0] if lzw else DEFLATE[0] if deflate else PLAIN[0]
    tags = [(WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (bands.itemsize * 8,) * n), (COMPRESSION, "H", (how,)), (262, "H", (1,)), (BANDS, "H", (n,)), (PLANAR, "H", (2,)), (TILE_WIDTH, "I", (tile,)), (TILE_HEIGHT, "I", (tile,)), (TILE_OFFSETS, "Q", tuple(p for p, _ in places)), (TILE_SIZES, "Q", tuple(s for _, s in places)), (FORMAT, "H", (kind,) * n), (PIXEL_SCALE, "d", (pixel, pixel, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, x0, y0, 0.0))]
    codes, at = {"H": 3, "I": 4, "Q": 16, "d": 12}, 16 + len(body)
    entries, extra, base = b"", b"", at + 8 + 20 * len(tags) + 8
    for t, code, values in tags:
        raw = struct.pack(f"<{len(values)}{code}", *values)
        if len(raw) > 8:
            entries += struct.pack("<HHQQ", t, codes[code], len(values), base + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHQ", t, codes[code], len(values)) + raw.ljust(8, b"\0")
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, at) + bytes(body) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + extra


def write_geotiffs(pixels_df: DataFrame, path: str, shape: tuple[int, int], bands: int, kind: str = "int16", origin: tuple[float, float] = (0.0, 0.0), pixel: float = 1.0, tile: int = 256, lzw: bool = True) -> int:
    """Writes rows (name, band from 1, row, col, value) as files below ``path``, each built in the task
    that has its pixels; pixels without a row are 0. Returns the number of files."""
    schema = "name string, content binary"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((bands, *shape), kind)
        known = part[part["value"].notna()]
        x[known["band"].to_numpy() - 1, known["row"].to_numpy(), known["col"].to_numpy()] = known["value"].to_numpy()
        return pd.DataFrame([(part["name"].iloc[0], build_geotiff(x, *origin, pixel, tile, lzw=lzw))], columns=["name", "content"])

    return write_files(pixels_df.select("name", "band", "row", "col", "value").groupBy("name").applyInPandas(run, schema), path)
