"""Hand-computed cases of each operator family."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import calendar as C
from tessera.functions import scalars as S
from tessera.functions import vectors as V
from tessera.operators import attribute as A
from tessera.operators import compare as M
from tessera.operators import curves as U
from tessera.operators import distance as D
from tessera.operators import grid as G
from tessera.operators import labels as L
from tessera.operators import raster as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def near(x):
    return pytest.approx(x, abs=1e-6)


def test_indices(spark):
    b, r, n = (S.reflectance(F.lit(v)) for v in (500, 1000, 3000))
    got = one(spark, S.ndvi(r, n), S.evi(b, r, n))
    assert got[0] == near(0.5) and got[1] == near(0.327869)
    ok = [S.valid_pixel(F.lit(x), F.lit(1)) for x in (0, 1, 10000, 10001)] + [S.valid_pixel(F.lit(None).cast("int"))]
    assert list(one(spark, *(c.alias(str(i)) for i, c in enumerate(ok)))) == [False, True, True, False, False]


def test_cell_median_skips_invalid_pixels(spark):
    px = spark.createDataFrame([(1, 1, 1, 0.5, True), (1, 1, 1, 0.1, True), (1, 1, 1, 9.0, False), (2, 1, 1, 1.0, False)], "tile_id int, year int, window_index int, v double, ok boolean")
    got = {r["tile_id"]: (r["v"], r["valid_fraction"]) for r in L.cell_medians(px, F.col("ok"), {"v": F.col("v")}, pixels_per_cell=4).collect()}
    assert got == {1: (near(0.3), 0.5), 2: (None, 0.0)}


def history(spark, values, last):
    rows = [(1, 2017 + i, 5, v) for i, v in enumerate(values)] + [(1, 2024, 5, last)]
    return L.label_cells(spark.createDataFrame(rows, "tile_id int, year int, window_index int, ndvi double")).where("year = 2024").first()


HISTORY = (0.60, 0.62, 0.58, 0.61, 0.59, 0.60, 0.60)


@pytest.mark.parametrize("value, z, label", [(0.57, -2.323790, 1), (0.59, -0.774597, 0), (None, None, -1)])
def test_history_labels(spark, value, z, label):
    got = history(spark, HISTORY, value)
    assert got["history_mean"] == near(0.6) and got["history_std"] == near(0.0129099) and got["history_count"] == 7
    assert got["z"] == (None if z is None else near(z)) and got["label"] == label


@pytest.mark.parametrize("values", [(0.6,) * 7, (0.6,)])
def test_flat_or_short_history_is_unknown(spark, values):
    got = history(spark, values, 0.1)
    assert got["z"] is None and got["label"] == -1


def test_history_rows_are_bounded(spark):
    rows = [(1, 2017 + i, 5, float(v)) for i, v in enumerate((0, 0, 0, 0, 0, 0, 9))]
    z = [r["z"] for r in L.label_cells(spark.createDataFrame(rows, "tile_id int, year int, window_index int, ndvi double")).collect()]
    assert max(map(abs, z)) <= 6 / 7**0.5 + 1e-9


def test_modal_class(spark):
    got = [one(spark, R.modal_class(F.lit(a), F.lit(b)))[0] for a, b in ((3, 2), (3, 3), (0, 0))]
    assert got == [1, 5, 0]


def test_mosaic_takes_the_larger_code(spark):
    px = spark.createDataFrame([(0, 0, 1), (0, 0, 5), (0, 1, 0), (0, 1, 1)], "row int, col int, code int")
    assert {(r["col"], r["code"]) for r in R.mosaic_max(px).collect()} == {(0, 5), (1, 1)}


def test_composites(spark):
    px = spark.createDataFrame([(0, 4, 10), (0, 4, 21), (0, 9, 99), (1, 8, 7)], "k int, scl int, b int")
    got = {r["k"]: r["b"] for r in R.composite_median(px, ["k"], {"b": R.clear(F.col("scl"), F.col("b"))}).collect()}
    assert got == {0: 15, 1: 0}
    px = spark.createDataFrame([(0, -32768.0), (0, 4.0), (0, None), (1, -32768.0)], "k int, v double")
    assert {r["k"]: r["v"] for r in R.composite_mean(px, ["k"], {"v": R.radar(F.col("v"))}).collect()} == {0: 4.0, 1: None}


def test_focal_mean(spark):
    px = spark.createDataFrame([(r, c, 25.0 if (r, c) == (5, 5) else 0.0) for r in range(11) for c in range(11)], "row int, col int, v double")
    got = {(r["row"], r["col"]): r["v"] for r in R.focal_mean(px, "v").collect()}
    assert len(got) == 121 and all(v == (1.0 if max(abs(r - 5), abs(c - 5)) <= 2 else 0.0) for (r, c), v in got.items())
    other = {(r["row"], r["col"]): r["v"] for r in R.focal_mean_separable(px, "v").collect()}
    assert all(got[k] == near(other[k]) for k in got)


def test_calendar(spark):
    w = {r["window_index"]: r for r in C.windows(spark, [2024]).collect()}
    assert len(w) == 19 and w[1]["start_date"] == dt.date(2024, 4, 1)
    assert (w[14]["start_date"], w[14]["end_date"], w[14]["label"]) == (dt.date(2024, 9, 30), dt.date(2024, 10, 14), "2024_w14_sep30")
    assert [w[i]["start_date"].month for i in range(15, 20)] == [1, 2, 3, 11, 12] and w[16]["end_date"] == dt.date(2024, 3, 2)


def test_days_in_two_windows_and_none(spark):
    e = spark.createDataFrame([(1, dt.datetime(2023, 3, 1, 12)), (2, dt.datetime(2023, 10, 20)), (3, dt.datetime(2023, 4, 1))], "id int, ts timestamp_ntz")
    got = C.assign_windows(e, C.windows(spark, [2023]), "ts").groupBy("id").agg(F.sort_array(F.collect_list("window_index")).alias("w")).collect()
    assert {r["id"]: r["w"] for r in got} == {1: [16, 17], 3: [1]}


def test_names(spark):
    got = one(spark, C.parse_filename(F.lit("s2_2019_w17_mar01.tif")).alias("a"), C.parse_filename(F.lit("s3_2019.tif")).alias("b"))
    assert tuple(got["a"]) == ("s2", 2019, 17, dt.date(2019, 3, 1)) and got["b"] is None
    days = [one(spark, C.tuesday_on_or_before(F.lit(dt.date(2024, 4, d))))[0] for d in (1, 2)]
    assert days == [dt.date(2024, 3, 26), dt.date(2024, 4, 2)]
    assert one(spark, C.global_index(F.lit(2018), F.lit(1), 2017))[0] == 19


CURVE = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.6, 1), (0.1, 0)]


def test_curve_metrics(spark):
    df = spark.createDataFrame(CURVE, "s double, y int")
    m = U.binary_metrics(df, "y", "s").first()
    assert (m["n"], m["positives"]) == (6, 3)
    assert m["roc_auc"] == near(0.722222) and m["average_precision"] == near(0.755556)
    assert (m["best_threshold"], m["best_f1"], m["precision"], m["recall"]) == (0.6, near(0.75), near(0.6), near(1.0))
    back = U.binary_metrics(df.withColumn("s", -F.col("s")), "y", "s").first()
    assert m["roc_auc"] + back["roc_auc"] == near(1.0)


def test_curves_by_group_and_of_one_class(spark):
    rows = [(g, s, y) for g in ("a", None) for s, y in CURVE] + [("one", 0.5, 1), ("one", 0.4, 1), ("none", 0.3, 0)]
    got = {r["g"]: r for r in U.binary_metrics(spark.createDataFrame(rows, "g string, s double, y int"), "y", "s", ["g"]).collect()}
    assert got["a"]["roc_auc"] == got[None]["roc_auc"] == near(0.722222)
    assert got["one"]["roc_auc"] is None and got["none"]["roc_auc"] is None and got["none"]["average_precision"] is None


def test_curve_over_many_scores_like_plain(spark):
    import numpy as np

    r = np.random.default_rng(0)
    s, y = r.integers(0, 400, 3000) / 7.0, r.integers(0, 2, 3000)
    m = U.binary_metrics(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y int"), "y", "s").first()
    auc = np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
    assert m["roc_auc"] == near(auc)


def test_published_arithmetic(spark):
    rows = [(True, True)] * 372 + [(False, True)] * 798 + [(True, False)] * 16
    m = U.confusion(spark.createDataFrame(rows, "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (m["precision"], m["recall"], m["f1"]) == (near(0.317949), near(0.958763), near(0.477535))
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == len(rows)


def test_recall_without_positives_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 1, 0.1), (2, 0, 0.9)], "w int, y int, s double")
    assert {r["w"]: r["recall"] for r in U.recall_by(df, "y", "s", 0.5, ["w"]).collect()} == {1: 0.5, 2: None}


def test_vectors(spark):
    d = lambda a, b: one(spark, V.cosine_distance(F.lit(a), F.lit(b)))[0]
    assert d([1.0, 0.0], [1.0, 1.0]) == near(0.292893) and d([0.0, 0.0], [1.0, 1.0]) == 1.0 and d([3.0, 4.0], [3.0, 4.0]) == near(0)
    df = spark.createDataFrame([(1, [2.0, 4.0]), (1, None), (1, [4.0, 8.0])], "k int, v array<double>")
    got = V.mean_vector(df, ["k"], "v").first()
    assert (got["mean_vector"], got["n"]) == ([3.0, 6.0], 2)
    x = one(spark, V.normalise(F.lit([1.0, float("nan"), 5.0]), F.lit([0.0, 9.0, 1.0]), F.lit([2.0, 3.0, 4.0])))[0]
    assert x == [0.5, 0.0, 1.0]


def test_distance_without_history_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "k int, embedding array<double>")
    got = {r["k"]: (r["distance"], r["n_history"]) for r in D.distance_to_history(df.where("k = 1"), df, ["k"]).collect()}
    assert got == {1: (near(0), 1), 2: (None, 0)}


def test_lookback_is_by_value(spark):
    df = spark.createDataFrame([(1, 2024, 3, 0.8), (1, 2024, 5, 0.4), (1, 2024, 6, 0.1)], "tile_id int, year int, window_index int, ndvi double")
    got = {r["window_index"]: r["drop_recent"] for r in A.lookback(df, "ndvi").collect()}
    assert got == {3: None, 5: near(0.4), 6: None}


def test_neighbours(spark):
    tiles = spark.createDataFrame([(3 * i + j, 5120.0 * i, 5120.0 * j) for i in range(3) for j in range(3)], "tile_id long, x double, y double")
    got = {r["tile_id"]: r["count"] for r in G.neighbour_edges(tiles, 8192.0).groupBy("tile_id").count().collect()}
    assert got[4] == 8 and got[0] == got[8] == 3


def test_categories(spark):
    rows = [("flood", -25.0, 0.5, 3, 3), ("climatic_event_or_frost", None, 0.5, 2, 3), ("local_field", -5.0, 0.5, 1, None), ("drought", -5.0, None, 0, 2), ("other_unknown", None, 0.3, 5, 1)]
    got = A.categorise(spark.createDataFrame(rows, "want string, vv_db double, drop_recent double, n_stressed_neighbours int, usdm_class int")).collect()
    assert [r["category"] for r in got] == [r["want"] for r in got]
    assert [r["is_drought"] for r in got] == [True, True, False, True, False]


def test_polygons(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))))
    for (x, y), want in {(1, 1): True, (2, 3): False, (3.5, 3): True, (5, 1): False, (4, 2): True, (2, 0): True, (0, 4): True}.items():
        assert one(spark, G.in_polygon(F.lit(float(x)), F.lit(float(y)), ring))[0] is want, (x, y)


def test_grid_and_points(spark):
    grid = G.tile_grid(spark, (100.0, -100.0, 5121.0, 5120.0), 5120.0)
    assert [(r["tile_id"], r["x0"], r["y0"]) for r in grid.orderBy("tile_id").collect()] == [(1, 0.0, -5120.0), (2, 0.0, 0.0), (3, 5120.0, -5120.0), (4, 5120.0, 0.0)]
    pts = spark.createDataFrame([(1, 5120.0, 0.0), (2, 10.0, -1.0)], "p int, x double, y double")
    assert {r["p"]: r["tile_id"] for r in G.points_in_tiles(pts, grid, 5120.0).collect()} == {1: 4, 2: 1}


def test_percentiles_and_snapping(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    assert tuple(M.clip_range(df, "v").first()) == (near(1.15), near(8.95))
    assert list(one(spark, S.pixel_offset(F.lit(25.0), 0.0, 10.0).alias("a"), S.pixel_offset(F.lit(35.0), 0.0, 10.0).alias("b"), S.snap_down(F.lit(5121.0), 5120.0).alias("c"))) == [2, 4, 5120.0]


def test_side_by_side_is_the_intersection(spark):
    lab = spark.createDataFrame([(i, 2024, 1, i % 3 - 1) for i in range(6)], "tile_id int, year int, window_index int, label int")
    part = lambda keep: lab.where(F.col("tile_id").isin(*keep)).withColumn("s", F.col("tile_id") / 10)
    got = M.side_by_side(lab, {"a": (part([1, 2, 4, 5]), "s"), "b": (part([2, 3, 4]), "s")}, year=2024)
    assert sorted(r["tile_id"] for r in got.collect()) == [2, 4]
    doc = M.metrics_document(M.compare(got, ["a", "b"])).first()["document"]
    assert '"a":{' in doc and '"roc_auc"' in doc
