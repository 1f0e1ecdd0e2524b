"""Rings, holes, parts and unions; borders of focal means; files that are written and read back."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curves as U
from tessera.operators import grid as G
from tessera.operators import ordered as O
from tessera.operators import raster as R
from tessera.operators import union as N
from tessera.sources import geotiff, readers, stores

SQUARE = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def points(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def test_points_in_holes_and_parts(spark):
    shapes = [("hole", [points(SQUARE(0, 0, 10)), points(SQUARE(4, 4, 2)[::-1])]), ("parts", [points(SQUARE(20, 0, 5)), points(SQUARE(30, 0, 5))]), ("empty", [])]
    polygons = spark.createDataFrame(shapes, f"x string, rings {stores.RINGS}")
    spots = [(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 22.0, 2.0), (4, 27.0, 2.0), (5, 34.0, 4.0), (6, 4.0, 5.0), (7, None, 1.0), (None, 1.0, 1.0)]
    got = G.points_in_polygons(spark.createDataFrame(spots, "point_id int, x double, y double"), polygons, 7.0, order=[F.col("x")], ring="rings")
    assert got.columns == ["point_id", "x", "y", "polygon_x"]
    assert {r["point_id"]: r["polygon_x"] for r in got.collect()} == {1: None, 2: "hole", 3: "parts", 4: None, 5: "parts", 6: "hole", 7: None, None: None}
    b = G.bounds(polygons, "rings").first()
    assert tuple(b) == (0.0, 0.0, 35.0, 10.0)
    m = {r["x"]: (r["a"], r["c"]) for r in polygons.select("x", G.area(F.col("rings")).alias("a"), G.centroid(F.col("rings")).alias("c")).collect()}
    assert m["hole"][0] == 96.0 and tuple(m["hole"][1]) == (5.0, 5.0) and m["parts"][0] == 50.0 and tuple(m["parts"][1]) == (27.5, 2.5) and m["empty"] == (0.0, None)


def test_tiles_and_pixels_of_polygons(spark):
    tiles = G.tile_grid(spark, (0.0, 0.0, 40.0, 10.0), 10.0)
    polygons = spark.createDataFrame([(1, [points(SQUARE(-5, -5, 30)), points(SQUARE(9, -1, 12)[::-1])]), (2, [points([(31, 4), (32, 4), (32, 5)])])], f"k int, rings {stores.RINGS}")
    # the second tile is all inside the hole, the fourth holds a small polygon
    assert {r["x0"] for r in G.tiles_in_polygons(tiles, polygons, 10.0, "rings").collect()} == {0.0, 20.0, 30.0}
    px = spark.createDataFrame([(x + 0.5, 0.5) for x in range(-7, 30)], "x double, y double")
    assert {r["x"] for r in G.clip_to_polygons(px, polygons, 10.0, ring="rings").collect()} == {x + 0.5 for x in [*range(-5, 9), *range(21, 25)]}


def cells_of(rings, n):
    """Unit squares whose centres an odd number of rings holds."""
    def holds(ring, x, y):
        inside = False
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
        return inside

    return {(i, j) for i in range(n) for j in range(n) if sum(holds(r, i + 0.5, j + 0.5) for r in rings) % 2}


@pytest.mark.parametrize("seed", range(6))
def test_union_like_cells(seed):
    r = random.Random(seed)
    shapes = []
    for _ in range(r.randrange(1, 12)):
        x, y, w, h = r.randrange(0, 12), r.randrange(0, 12), r.randrange(1, 8), r.randrange(1, 8)
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        shapes.append([ring[:: r.choice([1, -1])]])
        if w > 2 and h > 2 and r.random() < 0.5:
            shapes[-1].append([(x + 1, y + 1), (x + w - 1, y + 1), (x + w - 1, y + h - 1), (x + 1, y + h - 1)])
    want = set().union(*(cells_of(s, 20) for s in shapes))
    got = N.union_rings([[np.array(x, float) for x in s] for s in shapes])
    assert cells_of(got, 20) == want
    assert sum(shoelace(x) for x in got) == pytest.approx(len(want))


def test_union_of_slanted_and_adjacent_polygons():
    # two crossed bars, turned by 45 degrees: 2 * 20 - 4 = 36
    bar = lambda a, b: [((x - y) / 2**0.5, (x + y) / 2**0.5) for x, y in [(-a, -b), (a, -b), (a, b), (-a, b)]]
    got = N.union_rings([[np.array(bar(5, 1))], [np.array(bar(1, 5))]])
    assert len(got) == 1 and len(got[0]) == 12 and shoelace(got[0]) == pytest.approx(36, abs=1e-4)
    # neighbours that share a border with a corner that only one of them has
    got = N.union_rings([[np.array(SQUARE(0, 0, 2), float)], [np.array([(2, 0), (4, 0), (4, 2), (2, 2), (2, 1)], float)]])
    assert len(got) == 1 and sorted(got[0]) == [(0, 0), (0, 2), (4, 0), (4, 2)]
    ring = N.union_rings([[np.array(SQUARE(x, y, 1), float)] for x in range(3) for y in range(3) if (x, y) != (1, 1)])
    assert sorted(map(shoelace, ring)) == [-1, 9]
    assert N.union_rings([]) == N.union_rings([[]]) == []


def test_union_by_group(spark):
    rows = [("a", points(SQUARE(0, 0, 2))), ("a", points(SQUARE(1, 1, 2))), ("a", points(SQUARE(0, 0, 2))), ("a", None), (None, points(SQUARE(0, 0, 1))), ("e", None)]
    got = {r["g"]: r for r in N.union_polygons(spark.createDataFrame(rows, f"g string, ring {stores.RING}"), ["g"]).withColumn("a", G.area(F.col("rings"))).collect()}
    assert {k: (r["a"], r["n_polygons"]) for k, r in got.items()} == {"a": (7.0, 4), None: (1.0, 1), "e": (0.0, 1)}
    assert N.union_polygons(spark.createDataFrame([], f"g string, ring {stores.RING}"), ["g"]).count() == 0


def mirror(i, n):
    return -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i


def test_focal_mean_reflects_its_border(spark):
    # by hand: of the corner's 25 neighbours 9 are rows and columns 0 to 2, of which 0 and 1 come twice
    a = np.arange(36.0).reshape(6, 6)
    rows = [(k, i, j, float(a[i, j]) * k) for k in (1, 2) for i in range(6) for j in range(6)]
    px = spark.createDataFrame(rows, "band int, row int, col int, v double")
    got = {(r["band"], r["row"], r["col"]): r["v"] for r in R.focal_mean(px, "v", keys=["band"]).collect()}
    corner = sum(a[i, j] * wi * wj for i, wi in ((0, 2), (1, 2), (2, 1)) for j, wj in ((0, 2), (1, 2), (2, 1))) / 25
    assert got[1, 0, 0] == pytest.approx(corner) and corner == pytest.approx(5.6)
    for k, i, j, _ in rows:
        assert got[k, i, j] == pytest.approx(k * np.mean([a[mirror(i + p, 6), mirror(j + q, 6)] for p in range(-2, 3) for q in range(-2, 3)]))
    flat = {r["v"] for r in R.focal_mean(px.withColumn("v", F.lit(1.0)), "v", keys=["band"], shape=(6, 6)).collect()}
    assert flat == {1.0}


def test_focal_mean_of_missing_pixels(spark):
    r = random.Random(1)
    a = {(i, j): r.random() for i in range(7) for j in range(5) if r.random() < 0.6}
    got = {(x["row"], x["col"]): x["v"] for x in R.focal_mean(spark.createDataFrame([(*k, v) for k, v in a.items()], "row int, col int, v double"), "v", shape=(7, 5)).collect()}
    assert set(got) == set(a)
    for i, j in a:
        assert got[i, j] == pytest.approx(sum(a.get((mirror(i + p, 7), mirror(j + q, 5)), 0) for p in range(-2, 3) for q in range(-2, 3)) / 25)


def test_chips_are_padded_and_resampled(spark):
    px = spark.createDataFrame([(1, 10.0 * c + 5, 10.0 * r + 5, float(10 * r + c)) for r in range(4) for c in range(4)], "band int, x double, y double, value double")
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 40.0), (2, 20.0, 20.0, 60.0, 60.0), (3, 100.0, 0.0, 140.0, 40.0)], "tile_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["tile_id"], r["band"]): r["chip"] for r in R.chips(px, tiles, 10.0, size=4, bands=(1, 2)).collect()}
    assert got[1, 1] == [float(10 * r + c) for r in (3, 2, 1, 0) for c in range(4)]
    assert got[2, 1] == [0.0] * 8 + [32.0, 33.0, 0.0, 0.0, 22.0, 23.0, 0.0, 0.0] and got[3, 1] == got[1, 2] == [0.0] * 16
    fine = {r["tile_id"]: r["chip"] for r in R.chips(px, tiles.where("tile_id = 1"), 10.0, size=8).collect()}[1]
    assert fine == [got[1, 1][(i // 16) * 4 + (i % 8) // 2] for i in range(64)]


def test_regrid_takes_the_nearest(spark):
    px = spark.createDataFrame([(2.0, 28.0, 1.0), (6.0, 24.0, 2.0), (15.0, 25.0, 3.0), (99.0, 25.0, 4.0), (25.0, 5.0, 5.0)], "x double, y double, value double")
    got = {(r["row"], r["col"]): r["value"] for r in R.regrid(px, (0.0, 30.0), 10.0, (3, 3)).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 3.0, (2, 2): 5.0}


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("advisory", ["1m", "64m"])
def test_renumber_keeps_every_row(spark, adaptive, advisory):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        wide = spark.range(400_000).select((F.xxhash64("id") % 300_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
        got = O.renumber(wide, "k").cache()
        m = got.agg(F.count("new_id").alias("n"), F.countDistinct("new_id").alias("d"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi")).first()
        assert tuple(m) == (400_000, 400_000, 1, 400_000)
        bad = got.alias("a").join(got.alias("b"), F.col("a.new_id") + 1 == F.col("b.new_id")).where("a.k > b.k").count()
        assert bad == 0
        got.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_renumber_of_one_value_and_of_nothing(spark):
    same = spark.range(5000).select(F.lit(1).alias("k"), "id")
    assert sorted(r["new_id"] for r in O.renumber(same, "k", start=0).collect()) == list(range(5000))
    assert O.renumber(same.where("false"), "k").count() == 0


def test_metrics_of_groups_with_any_name(spark):
    rows = [(g, s, y) for g in ("a", "b") for s, y in [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.6, 1), (0.1, 0)]]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    for name in ("n", "p", "pos", "tp", "fp", "total", "_b", "_g", "label"):
        got = U.binary_metrics(df.withColumnRenamed("g", name), "y", "s", [name])
        assert got.columns[0] == name
        assert [(r[0], round(r["roc_auc"], 6), round(r["average_precision"], 6)) for r in got.orderBy("best_f1").collect()] in ([("a", 0.722222, 0.755556), ("b", 0.722222, 0.755556)], [("b", 0.722222, 0.755556), ("a", 0.722222, 0.755556)])
    c = U.confusion(df.withColumnRenamed("g", "tp"), F.col("y") == 1, F.col("s") > 0.5, ["tp"]).collect()
    assert sorted(tuple(r)[:5] for r in c) == [("a", 3, 2, 0, 1), ("b", 3, 2, 0, 1)]


def test_curves_of_many_ranges(spark):
    """A group whose scores lie apart from the others', and few rows a range."""
    r = np.random.default_rng(4)
    rows = [("low", float(x) / 1e6, int(y)) for x, y in zip(r.integers(0, 500, 1500), r.integers(0, 2, 1500))] + [("high", 1e6 + float(x), int(y)) for x, y in zip(r.integers(0, 700, 900), r.integers(0, 2, 900))]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = U.curve(df, "y", "s", ["g"], range_rows=50).collect()
    for g in ("low", "high"):
        mine = [(s, y) for h, s, y in rows if h == g]
        for x in (x for x in got if x["g"] == g):
            assert (x["tp"], x["pp"], x["total"]) == (sum(y for s, y in mine if s >= x["score"]), sum(s >= x["score"] for s, _ in mine), len(mine))
    p = {x["g"]: (x["a"], x["b"]) for x in U.percentiles(df, "s", {"a": 0.05, "b": 0.95}, ["g"]).collect()}
    for g in ("low", "high"):
        assert p[g] == tuple(pytest.approx(v) for v in np.percentile([s for h, s, _ in rows if h == g], [5, 95]))


def test_lzw_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5000, 60_000):
        for data in (r.integers(0, 4, n, dtype=np.uint8).tobytes(), r.integers(0, 256, n, dtype=np.uint8).tobytes()):
            assert geotiff._lzw(geotiff._lzw_packed(data)) == data


def test_geotiffs_are_written_by_tasks(spark, tmp_path):
    rows = [(f"s2_2024_w0{k}.tif", b, i, j, float(k * 100 + b * 10 + i + j)) for k in (1, 2) for b in (1, 2) for i in range(20) for j in range(9)]
    df = spark.createDataFrame(rows, "name string, band int, row int, col int, value double")
    assert geotiff.write_geotiffs(df, str(tmp_path / "out"), (20, 9), 2, tile=16) == 2
    assert geotiff.write_geotiffs(df.where("name like '%w01%'"), str(tmp_path / "out"), (20, 9), 2, tile=16) == 1  # again: replaced
    px = geotiff.pixels(geotiff.read_geotiff(spark, str(tmp_path / "out"), strict=True))
    got = sorted((r["path"].rpartition("/")[2], r["band"], r["row"], r["col"], r["value"]) for r in px.collect())
    assert got == sorted(rows)


def patched(data, tag, value):
    """A copy of a BigTIFF with another first value of a tag."""
    import struct

    at = struct.unpack_from("<Q", data, 8)[0]
    for k in range(struct.unpack_from("<Q", data, at)[0]):
        if struct.unpack_from("<H", data, at + 8 + 20 * k)[0] == tag:
            return data[: at + 20 + 20 * k] + struct.pack("<H", value) + data[at + 22 + 20 * k :]
    raise KeyError(tag)


def test_unknown_and_cut_files_are_reported(spark, tmp_path):
    x = np.arange(64, dtype="int16").reshape(1, 8, 8)
    good = geotiff.build_geotiff(x, tile=16)
    (tmp_path / "good.tif").write_bytes(good)
    (tmp_path / "cut.tif").write_bytes(good[:40])
    (tmp_path / "zstd.tif").write_bytes(patched(good, geotiff.COMPRESSION, 50000))
    with pytest.raises(Exception, match="compression 50000"):
        geotiff.read_geotiff(spark, str(tmp_path)).collect()
    rows = geotiff.read_geotiff(spark, str(tmp_path), errors=True).collect()
    assert {r["path"].rpartition("/")[2]: r["error"] is None for r in rows} == {"good.tif": True, "cut.tif": False, "zstd.tif": False}
    bad = geotiff.quarantine(spark, str(tmp_path), min_bytes=10).collect()
    assert sorted(r["path"].rpartition("/")[2] for r in bad) == ["cut.tif", "zstd.tif"]
    data = geotiff.build_geotiff(x, tile=16, deflate=False)
    with pytest.raises(ValueError, match="cut off"):
        list(geotiff.blocks(patched(data, geotiff.TILE_SIZES, 60000)))


def test_floating_predictor(tmp_path):
    """A strip of floats whose bytes are split by significance and differenced."""
    import struct

    x = np.linspace(-5, 9, 24, dtype="<f4").reshape(4, 6)
    split = x.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    raw = np.diff(split, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8).tobytes()
    packed = zlib.compress(raw)
    tags = [(256, 6), (257, 4), (258, 32), (259, 8), (273, 8), (277, 1), (278, 4), (279, len(packed)), (317, 3), (339, 3)]
    data = b"II" + struct.pack("<HI", 42, 8 + len(packed)) + packed + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)
    (_, _, _, got), = geotiff.blocks(data)
    assert (got == x).all()


def test_corrupt_parquet_is_named(spark, tmp_path):
    path = tmp_path / "c"
    spark.range(9).write.parquet(str(path))
    (path / "part-x.parquet").write_bytes(b"PAR1" + b"\0" * 40)
    (path / "part-y.parquet").write_bytes(b"PA")
    assert {r["path"].rpartition("/")[2]: r["error"] for r in readers.corrupt_files(spark, str(path)).collect()} == {"part-x.parquet": "cut off", "part-y.parquet": "too short"}
    with pytest.raises(Exception):  # noqa: B017
        readers.partitioned(spark, str(path)).collect()


def test_geopackage_keeps_all_rings(spark, tmp_path):
    rows = [(1, [points(SQUARE(0, 0, 10)), points(SQUARE(4, 4, 2)[::-1]), points(SQUARE(20, 0, 5)), points(SQUARE(21, 1, 2)[::-1])]), (2, [points(SQUARE(0, 0, 1))])]
    df = spark.createDataFrame(rows, f"k long, rings {stores.RINGS}")
    (tmp_path / "t.gpkg").write_bytes(stores.build_geopackage(df, "aoi"))
    got = {r["k"]: r["rings"] for r in stores.read_geopackage(spark, str(tmp_path), "aoi", "k long", rings=True).collect()}
    assert {k: sorted([tuple(p) for p in r] for r in v) for k, v in got.items()} == {r["k"]: sorted([tuple(p) for p in x] for x in r["rings"]) for r in df.collect()}
    with pytest.raises(Exception, match="rings=True"):
        stores.read_geopackage(spark, str(tmp_path), "aoi", "k long").collect()


def test_shapefile_records_keep_their_rings(spark, tmp_path):
    import struct

    parts = [SQUARE(0, 0, 10), SQUARE(4, 4, 2)[::-1]]
    flat = [p for r in parts for p in r]
    rec = struct.pack("<I4d2I", 5, 0, 0, 1, 1, 2, len(flat)) + struct.pack("<2I", 0, 4) + b"".join(struct.pack("<2d", *p) for p in flat)
    null = struct.pack("<I", 0)
    body = struct.pack(">2I", 1, len(rec) // 2) + rec + struct.pack(">2I", 2, 2) + null
    (tmp_path / "a.shp").write_bytes(struct.pack(">I", 9994) + b"\0" * 96 + body)
    (r,) = readers.read_shapefiles(spark, str(tmp_path)).collect()
    assert r["ring"] is None and [[tuple(p) for p in x] for x in r["rings"]] == [[(float(a), float(b)) for a, b in x] for x in parts]


def test_cube_of_version_3_with_unequal_chunks(spark, tmp_path):
    """As the stage creates it: a chunk a window for vectors, a chunk a year for the mask."""
    path = str(tmp_path / "cube")
    stores.open_cube(spark, path, 5, 38, 4)
    cell = lambda t, w: [float(t), float(w), 1.0, -1.0]
    df = spark.createDataFrame([(t, w, cell(t, w)) for t in range(5) for w in (0, 7, 20)] + [(3, 9, None)], "tile long, window long, embedding array<float>")
    assert stores.write_cube(df, path) == 3 + 2
    stores.open_cube(spark, path, 5, 38, 4)  # already there
    again = spark.createDataFrame([(2, 8, cell(2, 8))], "tile long, window long, embedding array<float>")
    assert stores.write_cube(again, path) == 2
    got = {(r["tile"], r["window"]): r["embedding"] for r in stores.read_cube(spark, path).collect()}
    assert got == {(t, w): cell(t, w) for t in range(5) for w in (0, 7, 20)} | {(2, 8): cell(2, 8)}
    with pytest.raises(ValueError):
        stores.open_cube(spark, path, 6, 38, 4)


def test_cube_by_another_writer(spark, tmp_path):
    """Plain bytes, big ends first, and a chunk of the mask that was never written."""
    import json

    x = np.arange(3 * 4 * 2, dtype=">f4").reshape(3, 4, 2)
    for name, shape, chunks, kind in (("embedding", [3, 4, 2], [3, 1, 2], "float32"), ("mask", [3, 4], [2, 3], "bool")):
        d = tmp_path / name
        (d / "c").mkdir(parents=True)
        codecs = [{"name": "bytes", "configuration": {"endian": "big"}}]
        (d / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}, "codecs": codecs}))
    for w in range(4):
        (tmp_path / "embedding" / "c" / f"0.{w}.0").write_bytes(x[:, w : w + 1].tobytes())
    (tmp_path / "mask" / "c" / "0.0").write_bytes(np.array([[1, 0, 1], [0, 1, 1]], bool).tobytes())
    (tmp_path / "mask" / "c" / "1.1").write_bytes(np.array([[1, 0, 0], [0, 0, 0]], bool).tobytes())
    got = {(r["tile"], r["window"]): r["embedding"] for r in stores.read_cube(spark, str(tmp_path)).collect()}
    assert got == {(t, w): x[t, w].tolist() for t, w in ((0, 0), (0, 2), (1, 1), (1, 2), (2, 3))}
