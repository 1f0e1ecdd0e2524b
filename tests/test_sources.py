import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import embed as E
from tessera.operators import sequence as Q
from tessera.sources import readers
from tessera.streaming import ledger as W


def shapefile(rings, attributes):
    """Bytes of a .shp of polygons and of its .dbf (one text field)."""
    body = b""
    for k, ring in enumerate(rings):
        pts = b"".join(struct.pack("<2d", *p) for p in ring)
        rec = struct.pack("<I4d2I", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<I", 0) + pts
        body += struct.pack(">2I", k + 1, len(rec) // 2) + rec
    shp = struct.pack(">I", 9994) + b"\0" * 96 + body
    field = b"DM".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    rows = b"".join(b" " + a.ljust(4).encode() for a in attributes)
    return shp, struct.pack("<4BIHH20x", 3, 24, 1, 1, len(attributes), 32 + 32 + 1, 5) + field + b"\r" + rows


def test_shapefiles(spark, tmp_path):
    shp, dbf = shapefile([[(0, 0), (1, 0), (1, 1), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]], ["2", "4"])
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf)
    (tmp_path / "b.shp").write_bytes(shp)
    got = readers.read_shapefiles(spark, str(tmp_path)).select("record", readers.attribute(F.col("attributes"), "dm", "DM").alias("dm"), F.size("ring").alias("n"), F.col("ring")[1]["x"].alias("x"), F.col("path").endswith("/a").alias("a")).collect()
    assert sorted((r["record"], r["dm"], r["n"], r["x"]) for r in got if r["a"]) == [(1, "2", 4, 1.0), (2, "4", 4, 6.0)]
    assert [r["dm"] for r in got if not r["a"]] == [None, None]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("s2", 2023, 1, 1), ("s2", 2024, 1, 2)], "sensor string, year int, window_index int, v int")
    readers.write_partitioned(df, path)
    readers.write_partitioned(df.where("year = 2024").withColumn("v", F.lit(9)), path)
    assert {r["year"]: r["v"] for r in readers.partitioned(spark, path).collect()} == {2023: 1, 2024: 9}
    one = readers.partitioned(spark, path, 2024)
    assert one.count() == 1 and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()


def test_usable_files(spark, tmp_path):
    for name, n in (("s1_a.tif", 10), ("s1_b.tif", 2000), ("s1_c.tif", 3000), ("x.txt", 5000)):
        (tmp_path / name).write_bytes(b"x" * n)
    files = readers.usable_files(spark, str(tmp_path), "s1_*.tif").withColumn("k", F.lit(1))
    assert files.count() == 2 and readers.first_file(files, ["k"]).first()["path"].endswith("s1_b.tif")


def test_ledger_csv(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert readers.read_ledger(spark, path, W.LEDGER).count() == 0
    planned = W.plan(spark, [2023, 2024], only_year=2024)
    assert planned.count() == 38 and W.plan(spark, [2023], only_year=2024).count() == 0
    readers.write_ledger(planned.withColumn("status", F.when(F.col("sensor") == "s1", "FAILED").otherwise("SYNCED")).withColumn("task_id", F.lit("t")), path)
    merged = W.merge(W.plan(spark, [2023, 2024]), readers.read_ledger(spark, path, W.LEDGER))
    got = {(r["sensor"], r["year"], r["status"], r["task_id"]): r["count"] for r in merged.groupBy("sensor", "year", "status", "task_id").count().collect()}
    assert got == {("s1", 2023, "PENDING", ""): 19, ("s2", 2023, "PENDING", ""): 19, ("s1", 2024, "PENDING", ""): 19, ("s2", 2024, "SYNCED", "t"): 19}
    assert W.remaining(W.plan(spark, [2024]), merged.where("status = 'SYNCED'")).count() == 19


def test_states(spark):
    rows = [("PENDING", "submitted", "RUNNING"), ("RUNNING", "finished", "DONE"), ("DONE", "moved", "SYNCED"), ("RUNNING", "error", "FAILED"), ("SYNCED", "error", "SYNCED"), ("RUNNING", "unknown", "RUNNING")]
    df = spark.createDataFrame(rows, "s string, e string, want string")
    assert df.where(W.advance(F.col("s"), F.col("e")) != F.col("want")).count() == 0


def test_drain_takes_each_file_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for k in range(5):
        spark.range(k + 1).coalesce(1).write.mode("append").parquet(source)
    work = lambda df, n: seen.append(df.count())
    W.drain(spark, source, T.StructType([T.StructField("id", T.LongType())]), str(tmp_path / "cp"), work, max_files=2)
    assert sum(seen) == 15 and len(seen) == 3
    W.drain(spark, source, T.StructType([T.StructField("id", T.LongType())]), str(tmp_path / "cp"), work, max_files=2)
    assert len(seen) == 3


def test_scene_search_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "cat")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = [(1, 0.0, 2.0, 0.0, 2.0, "2024-01-02", 10.0, "IW", ["VV", "VH"]), (2, 5.0, 6.0, 0.0, 1.0, "2024-01-02", 10.0, "IW", ["VV"]), (3, 0.0, 1.0, 0.0, 1.0, "2024-01-02", 90.0, "EW", ["VV"]), (4, 0.0, 1.0, 0.0, 1.0, "2024-02-01", 1.0, "IW", ["VV"])]
    spark.createDataFrame(rows, "id int, min_x double, max_x double, min_y double, max_y double, ts string, cloud_cover double, mode string, polarisation array<string>").write.parquet(path)
    got = readers.scene_search(spark.read.parquet(path), (1.0, 1.0, 3.0, 3.0), "2024-01-01", "2024-02-01", 80.0, "IW", ("VV",))
    assert [r["id"] for r in got.collect()] == [1]
    assert "LessThan(cloud_cover,80.0)" in got._jdf.queryExecution().toString()


def test_documents(spark, tmp_path):
    meta = readers.encoder_metadata(spark, '{"s2": {"gsd": 10, "bands": {"mean": {"red": 1}, "std": {"red": 2}, "wavelength": {"red": 0.6}}}}').first()
    assert tuple(meta) == ("s2", "red", 1.0, 2.0, 0.6, 10.0)
    listing = '[{"ID": "a", "Name": "x", "IsDir": true}, {"ID": "b", "Name": "y", "IsDir": false}]'
    assert spark.range(1).select(readers.listing_ids(F.lit(listing))).first()[0] == ["a"]
    readers.write_json(spark.createDataFrame([('{"a":1}',)], "d string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["a"] == 1


def test_sequences_are_dense(spark):
    facts = spark.createDataFrame([(1, 2024, 2, [1.0, 2.0], 1), (1, 2024, 3, [3.0, 4.0], -1)], "tile_id int, year int, window_index int, embedding array<double>, label int")
    seq = Q.dense_sequences(facts, 4, 2).first()["seq"]
    assert [(s["step"], s["vector"], s["label"], s["valid"]) for s in seq] == [(1, [0.0, 0.0], -1, False), (2, [1.0, 2.0], 1, True), (3, [3.0, 4.0], -1, False), (4, [0.0, 0.0], -1, False)]


def test_gru_gradients_and_training():
    import numpy as np

    r = np.random.default_rng(0)
    net = Q.GRU.new(3, 4, 1)
    x, d = r.normal(size=(2, 5, 3)), r.normal(size=(2, 5))
    g = net.gradients(x, net.forward(x)[1], d)
    for name in ("wx", "wh", "b", "out"):
        w = getattr(net, name)
        at = np.unravel_index(w.size // 2, w.shape)
        keep, e = w[at], 1e-6
        w[at] = keep + e
        up = (net.forward(x)[0] * d).sum()
        w[at] = keep - e
        down = (net.forward(x)[0] * d).sum()
        w[at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-7)
    x = r.normal(size=(200, 6, 3))
    y = (np.cumsum(x[:, :, 0], axis=1) > 0).astype(int)
    net = Q.train_gru(x, y, np.ones_like(y, bool), hidden=8, epochs=60, rate=1e-2)
    assert ((net.forward(x)[0] > 0) == y).mean() > 0.9


def test_gru_of_the_best_epoch():
    import numpy as np

    r = np.random.default_rng(3)
    x, other = r.normal(size=(60, 4, 2)), r.normal(size=(40, 4, 2))
    y, z = (x[:, :, 0] + 2 * r.normal(size=(60, 4)) > 0).astype(int), (other[:, :, 0] + r.normal(size=(40, 4)) > 0).astype(int)
    all_, some = np.ones_like(y, bool), r.random((40, 4)) < 0.8

    def auc(net):
        p = net.forward(other)[0][some]
        pairs = [(a > b) + (a == b) / 2 for a in p[z[some] == 1] for b in p[z[some] == 0]]
        return sum(pairs) / len(pairs)

    after = [auc(Q.train_gru(x, y, all_, hidden=3, epochs=k, rate=5e-2)) for k in range(1, 31)]
    best = Q.train_gru(x, y, all_, watched=(other, z, some), hidden=3, epochs=30, rate=5e-2)
    assert auc(best) == pytest.approx(max(after)) and max(after) > after[-1]
    one_kind = Q.train_gru(x, y, all_, watched=(other, np.ones_like(z), some), hidden=3, epochs=30, rate=5e-2)
    assert auc(one_kind) == pytest.approx(after[-1])
    assert Q.rank_auc(np.array([0, 1, 1, 0]), np.array([0.1, 0.1, 0.9, 0.2])) == pytest.approx(0.625)
    assert np.isnan(Q.rank_auc(np.array([1, 1]), np.array([0.1, 0.2])))


def test_gru_weights_round_trip(spark, tmp_path):
    net = Q.GRU.new(3, 2, 5)
    net.weights(spark).write.parquet(f"file://{tmp_path}/net")
    back = Q.GRU.of(spark.read.parquet(f"file://{tmp_path}/net"))
    assert all((getattr(net, n) == getattr(back, n)).all() for n in ("wx", "wh", "b", "out")) and net.out_b == back.out_b
    empty = Q.dense_sequences(spark.createDataFrame([], "tile_id int, year int, window_index int, embedding array<double>, label int"), 3, 2)
    with pytest.raises(ValueError):
        Q.fit_gru(empty)


def test_gru_scores_every_step(spark):
    facts = spark.createDataFrame([(t, 2024, 1 + t % 3, [float(t), 1.0], t % 2) for t in range(8)], "tile_id int, year int, window_index int, embedding array<double>, label int")
    seq = Q.dense_sequences(facts, 3, 2)
    got = Q.score_gru(seq, Q.fit_gru(seq, hidden=4, epochs=2)).collect()
    assert len(got) == 24 and all(0 < r["p_stressed"] < 1 for r in got) and sum(r["valid"] for r in got) == 8


def test_encoder_is_pluggable(spark):
    chips = spark.createDataFrame([(1, q, [float(q), 2.0], [1.0]) for q in range(4)] + [(2, 0, [0.0, 0.0], [0.0])], "tile_id int, quadrant int, pixels array<double>, meta array<double>")
    got = E.pool_quadrants(E.embed(chips, lambda p, m: p + m, batch=3), ["tile_id"])
    assert {r["tile_id"]: r["embedding"] for r in got.collect()} == {1: [2.5, 3.0], 2: [0.0, 0.0]}
    a, b = (E.RandomProjection(8)(__import__("numpy").ones((1, 2)), __import__("numpy").ones((1, 1))) for _ in range(2))
    assert (a == b).all() and a.shape == (1, 8)
