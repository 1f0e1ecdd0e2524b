import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import projection as P
from tessera.operators import ordered as O
from tessera.sources import geotiff, stores


def lzw(data: bytes) -> bytes:
    """Codes of nine bits with frequent clears, as any decoder must take them."""
    bits = "".join(format(c, "09b") for i in range(0, len(data), 100) for c in (256, *data[i : i + 100])) + format(257, "09b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw():
    data = bytes(range(200)) * 3
    assert geotiff._lzw(lzw(data)) == data


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("kind", ["uint8", "int16", "float32"])
def test_geotiff(spark, tmp_path, kind, deflate):
    r = np.random.default_rng(0)
    x = (r.random((2, 40, 35)) * 100).astype(kind)
    (tmp_path / "s2_2024_w01_apr01.tif").write_bytes(geotiff.build_geotiff(x, 1000.0, 9000.0, 10.0, tile=16, deflate=deflate))
    (tmp_path / "cut.tif").write_bytes(b"II\x2b\0")
    px = geotiff.pixels(geotiff.read_geotiff(spark, str(tmp_path)))
    got = {(p["band"], p["row"], p["col"]): p for p in px.collect()}
    assert len(got) == x.size and all(p["value"] == x[b - 1, i, j] for (b, i, j), p in got.items())
    assert (got[1, 3, 2]["x"], got[1, 3, 2]["y"]) == (1025.0, 8965.0)
    assert {r[0] for r in geotiff.read_geotiff(spark, str(tmp_path), bands=(2,)).select("band").collect()} == {2}
    with pytest.raises(Exception):  # noqa: B017
        geotiff.read_geotiff(spark, str(tmp_path), strict=True).collect()


def test_geopackage(spark, tmp_path):
    rows = [(1, "a", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]), (2, None, [{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 5.0}, {"x": 6.0, "y": 7.0}])]
    df = spark.createDataFrame(rows, f"tile_id long, name string, ring {stores.RING}")
    (tmp_path / "t.gpkg").write_bytes(stores.build_geopackage(df, "tiles"))
    got = stores.read_geopackage(spark, str(tmp_path), "tiles", "tile_id long, name string")
    assert sorted(got.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        stores.build_geopackage(df, "tiles", max_rows=1)


@pytest.mark.parametrize("packed", [True, False])
def test_cube(spark, tmp_path, packed):
    x = np.arange(3 * 4 * 2, dtype="<f4").reshape(3, 4, 2)
    ok = np.array([[1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 1, 1]], dtype="|b1")
    for name, a, chunks in (("embedding", x, [2, 1, 2]), ("mask", ok, [2, 1])):
        d = tmp_path / name
        d.mkdir()
        (d / ".zarray").write_text(json.dumps({"shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": "zlib"} if packed else None}))
        for t in range(2):
            for w in range(4):
                if (t, w) == (1, 3):
                    continue  # never written
                part = np.zeros((2, 1, *a.shape[2:]), a.dtype)
                got = a[2 * t : 2 * t + 2, w : w + 1]
                part[: got.shape[0]] = got
                raw = part.tobytes()
                (d / (f"{t}.{w}.0" if a.ndim == 3 else f"{t}.{w}")).write_bytes(zlib.compress(raw) if packed else raw)
    got = {(r["tile"], r["window"]): r["embedding"] for r in stores.read_cube(spark, str(tmp_path)).collect()}
    want = {(t, w): x[t, w].tolist() for t in range(3) for w in range(4) if ok[t, w] and (t, w) != (2, 3)}
    assert got == want


def test_projections(spark):
    one = lambda c: spark.range(1).select(c.alias("p")).first()["p"]
    p = one(P.to_utm(F.lit(-93.0), F.lit(45.0), 15))
    assert p["x"] == pytest.approx(500000.0) and p["y"] == pytest.approx(4984944.378 * 0.9996, abs=2e-3)
    for lon, lat in ((-93.6, 42.0), (-95.9, 43.5), (-90.1, 30.0)):
        p = one(P.to_utm(F.lit(lon), F.lit(lat), 15))
        back = one(P.from_utm(F.lit(p["x"]), F.lit(p["y"]), 15))
        assert (back["lon"], back["lat"]) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))
    south = one(P.to_utm(F.lit(-93.0), F.lit(-1.0), 15, south=True))
    assert 9_880_000 < south["y"] < 9_900_000
    a, b = one(P.to_albers(F.lit(-96.0), F.lit(23.0))), one(P.to_albers(F.lit(-93.5), F.lit(42.0)))
    assert a["x"] == pytest.approx(0) and a["y"] == pytest.approx(0, abs=1e-6) and 150_000 < b["x"] < 250_000 and 2_050_000 < b["y"] < 2_150_000


def test_albers_keeps_areas(spark):
    """A cell of a hundredth of a degree has the area it has on the ellipsoid."""
    lon, lat, d = -93.5, 42.0, 0.01
    corners = [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    p = [spark.range(1).select(P.to_albers(F.lit(x), F.lit(y)).alias("p")).first()["p"] for x, y in corners]
    area = abs(sum(p[i]["x"] * p[(i + 1) % 4]["y"] - p[(i + 1) % 4]["x"] * p[i]["y"] for i in range(4))) / 2
    e2, phi = P._E2, math.radians(lat + d / 2)
    m, n = P.A * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5, P.A / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    assert area == pytest.approx(m * math.radians(d) * n * math.cos(phi) * math.radians(d), rel=1e-5)


def test_ordered(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 0.1), ("b", 1, None)], "g string, t int, v double")
    assert {r["t"]: r["mid_rank"] for r in O.mid_rank(df.where("g = 'a'"), "v", ["g"]).collect()} == {4: 1.0, 1: 2.0, 2: 3.5, 3: 3.5}
    got = {r["t"]: (r["best"], r["is_best"]) for r in O.best_so_far(df.where("g = 'a'"), "v", "t", ["g"]).collect()}
    assert got == {1: (0.2, True), 2: (0.5, True), 3: (0.5, False), 4: (0.5, False)}
    assert {(r["g"], r["t"]) for r in O.first_of_key(df, ["g"], [-F.col("v"), F.col("t")]).collect()} == {("a", 2), ("b", 1)}
    many = spark.range(100, 1100).withColumn("k", -F.col("id"))
    assert [r["new_id"] for r in O.renumber(many, "k").orderBy("k").collect()] == list(range(1, 1001))
    once, again = ([r[0] for r in O.permutation(spark.range(20), s).collect()] for s in (1, 1))
    assert once == again != list(range(20)) and sorted(once) == list(range(20))
    with pytest.raises(KeyError):
        O.require(df, "g", ["a", "c"])
    assert O.require(df, "g", ["a"]).count() == 4 and O.missing(spark.createDataFrame([("z",), ("a",)], "g string"), df, "g").first()["g"] == "z"
    assert tuple(O.pivot_first(df, ["g"], "t", [1, 2, 9], "v").orderBy("g").first()) == ("a", 0.2, 0.5, None)
