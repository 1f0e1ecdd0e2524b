"""Queries of what is written and read back, of ledgers, panels, summaries and odd values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import compare as M
from ..operators import ordered as O
from ..operators import raster as R
from ..session import read_table, shared_path
from ..sources import geotiff, readers, stores
from ..sources.files import write_files
from ..streaming import ledger as W
from . import catalogue as K
from .inputs import SIDE, TILES, VECTORS, pixels, tiles, vectors
from .registry import query, rounded

# Files


def _yearly_composites(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A file a year, of the greatest class of each pixel."""
    p = R.mosaic_max(pixels(spark, sf_dir), "scl", ["year", "row", "col"])
    named = p.select(F.concat(F.lit("max_"), "year", F.lit(".tif")).alias("name"), F.lit(1).alias("band"), "row", "col", F.col("scl").cast("double").alias("value"))
    geotiff.write_geotiffs(named, path, (40, 40), 1, tile=16)


@query("""with g as (select cast(year(l_shipdate) as int) as year, cast(l_orderkey % 40 as int) as r, cast(l_partkey % 40 as int) as c, max(l_linenumber) as v from lineitem group by all)
select y.year, cast(a.i as int) as "row", cast(b.i as int) as col, cast(coalesce(v, 0) as double) as value from (select distinct year from g) y cross join range(40) a(i) cross join range(40) b(i) left join g on g.year = y.year and g.r = a.i and g.c = b.i""")
def geotiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites written by tasks as tiled files packed by LZW, and read as pixels."""
    _yearly_composites(spark, sf_dir, path := shared_path(spark, "composites"))
    px = geotiff.pixels(geotiff.read_geotiff(spark, path, strict=True))
    return px.select(F.regexp_extract("path", "max_([0-9]+)", 1).cast("int").alias("year"), "row", "col", "value")


@query("""select 'junk_' || n_name || '.tif' as name from nation""")
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole composites beside files that are none: the latter are named."""
    _yearly_composites(spark, sf_dir, path := shared_path(spark, "quarantine"))
    junk = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("junk_"), "n_name", F.lit(".tif")).alias("name"), F.repeat("n_name", 300).cast("binary").alias("content"))
    write_files(junk, path)
    return geotiff.quarantine(spark, path, min_bytes=10).select(F.substring_index("path", "/", -1).alias("name"))


@query("""with f as (select n_regionkey as region, 'chip_' || n_regionkey || '_' || printf('%02d', n_nationkey) || '.bin' as name, 512 * (n_nationkey % 5) + 1 as length from nation)
select region, min(name) as name, cast(min(length) as bigint) as least_length, count(*) as n_usable from f where length > 1024 group by 1""")
def usable_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files, some of them cut off, the first usable one of each region."""
    n = read_table(spark, sf_dir, "nation")
    name = F.format_string("chip_%d_%02d.bin", F.col("n_regionkey"), F.col("n_nationkey"))
    write_files(n.select(name.alias("name"), F.repeat(F.lit("x"), (512 * (F.col("n_nationkey") % 5)).cast("int")).cast("binary").alias("content")), path := shared_path(spark, "chips"))
    files = readers.usable_files(spark, path, "*.bin").withColumn("region", F.regexp_extract("path", "chip_([0-9]+)_", 1).cast("int"))
    n_usable = files.groupBy("region").agg(F.min("length").alias("least_length"), F.count(F.lit(1)).alias("n_usable"))
    return readers.first_file(files, ["region"]).join(n_usable, "region").select("region", F.substring_index("path", "/", -1).alias("name"), "least_length", "n_usable")


@query(f"""with {VECTORS} select cast(vec_id // 19 as bigint) as tile, cast(vec_id % 19 as bigint) as "window", cast(len(v) as int) as n, round(list_sum(v), 4) as total from vecs""")
def cube_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cells of a store with a chunk a window and a mask chunk a year."""
    v = vectors(spark, sf_dir).select(F.expr("vec_id div 19").alias("tile"), (F.col("vec_id") % 19).alias("window"), "embedding")
    extent = v.agg(F.max("tile").alias("t"), F.max(F.size("embedding")).alias("d")).first()
    stores.open_cube(spark, path := shared_path(spark, "cube"), (extent["t"] or 0) + 1, 19, extent["d"] or 1)
    stores.write_cube(v, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(stores.read_cube(spark, path).select("tile", "window", F.size("embedding").alias("n"), total.alias("total")), "total", digits=4)


@query(f"""with {TILES} select tile_id, x, y, cast(4 as int) as corners from tiles""")
def geopackage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile table, as a GeoPackage and back."""
    t = tiles(spark, sf_dir).withColumn("ring", K._square(SIDE))
    data = stores.build_geopackage(t, "tiles", srs=32615)
    write_files(spark.createDataFrame([("tiles.gpkg", bytearray(data))], "name string, content binary"), path := shared_path(spark, "gpkg"))
    back = stores.read_geopackage(spark, path, "tiles", "tile_id long, x double, y double")
    return back.select("tile_id", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"), F.size("ring").alias("corners"))


@query("""select year, sensor, case when year = 2000 then 0 else n end as n from (select cast(year(o_orderdate) as int) as year, o_orderstatus as sensor, count(*) as n from orders group by 1, 2)""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions by (sensor, year); those of 2000 are written again, the others stay."""
    o = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("sensor"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    path = shared_path(spark, "partitions")
    readers.write_partitioned(o, path, ("sensor", "year"))
    readers.write_partitioned(o.where("year = 2000").withColumn("n", F.lit(0).cast("long")), path, ("sensor", "year"))
    return readers.partitioned(spark, path).select("year", "sensor", "n")


@query(f"""with {K._CALENDAR} select 's2' as sensor, year, label as window_label, 's2_' || label as drive_filename, 'SYNCED' as status, '/x/' || label as local_path from cal where year = 2020""")
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of one year and sensor, finished, as a ledger file and back."""
    plan = W.plan(spark, range(2017, 2025), sensors=("s2",), only_year=2020)
    path = shared_path(spark, "ledger")
    readers.write_ledger(plan.withColumns({"status": F.lit("SYNCED"), "local_path": F.concat(F.lit("/x/"), "window_label")}), path)
    return readers.read_ledger(spark, path, W.LEDGER).drop("task_id")


@query("""select 'all' as method, count(*) as n, count(*) filter (where toxic = 1) as positives from labels""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics document: written as JSON, parsed again."""
    m = read_table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("positives")).withColumn("method", F.lit("all"))
    readers.write_json(M.metrics_document(m), path := shared_path(spark, "metrics"))
    document = F.from_json("value", "map<string, struct<n: long, positives: long>>")
    return spark.read.text(path).select(F.explode(document).alias("method", "m")).select("method", "m.n", "m.positives")


# Searches, names and documents


@query("""select event_type as mode, count(*) as n, round(sum(value), 2) as total from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' and user_id % 100 <= 60 and user_id % 100 + 5 >= 20 and event_type = 'click' and value > 100 group by 1""")
def radar_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar scenes: no cloud cover; an instrument mode, and both polarisations."""
    e = read_table(spark, sf_dir, "events")
    both = F.when(F.col("value") > 100, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))
    scenes = e.select("ts", (F.col("user_id") % 100).alias("min_x"), (F.col("user_id") % 100 + 5).alias("max_x"), F.lit(0).alias("min_y"), F.lit(1).alias("max_y"), F.col("event_type").alias("mode"), both.alias("polarisation"), "value")
    found = readers.scene_search(scenes, (20, 0, 60, 1), "2024-01-05", "2024-01-25", mode="click", polarisations=("VV", "VH"))
    return rounded(found.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query("""select event_id, unnest(case when value > 50 then ['a' || event_id, 'c'] else ['c'] end) as id from events""")
def folder_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the folders in JSON listings, in which files stand beside folders."""
    entry = lambda i, is_dir: F.concat(F.lit('{"ID": "'), i, F.lit('", "Name": "x", "IsDir": '), is_dir, F.lit("}"))
    e = read_table(spark, sf_dir, "events")
    listing = F.concat(F.lit("["), entry(F.concat(F.lit("a"), "event_id"), (F.col("value") > 50).cast("string")), F.lit(", "), entry(F.lit("b"), F.lit("false")), F.lit(", "), entry(F.lit("c"), F.lit("true")), F.lit("]"))
    return e.select("event_id", F.explode(readers.listing_ids(listing)).alias("id"))


@query("""select p_partkey, case when p_name like '% bolt' then substr(p_name, 1, length(p_name) - 5) else p_name end as stem from part""")
def stripped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", readers.strip_suffix(F.col("p_name"), " bolt").alias("stem"))


@query("""select cast(round_even((l_extendedprice - 900.0) / 25.0, 0) as int) as col, count(*) as n from lineitem group by 1""")
def pixel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-pixel offsets of points on a grid of 25 from 900, halves to even."""
    return read_table(spark, sf_dir, "lineitem").groupBy(S.pixel_offset(F.col("l_extendedprice"), 900.0, 25.0).alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding::double[]) as x from embeddings), s as (select i, avg(x) as m, stddev_samp(x) as sd from x group by 1)
select vec_id, cast(i as int) as i, case when abs(x) > 0.2 then 0.0 else round((x - m) / sd, 5) end as x from x join s using (i)""")
def band_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are not finite count as their band's mean."""
    v = vectors(spark, sf_dir)
    stats = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("b")).select(F.col("b.m").alias("mean"), F.col("b.s").alias("std"))  # one row
    holes = F.transform("embedding", lambda x: F.when(x > 0.2, float("nan")).when(x < -0.2, float("inf")).otherwise(x.cast("double")))
    out = v.crossJoin(F.broadcast(packed)).select("vec_id", F.posexplode(V.normalise(holes, F.col("mean"), F.col("std"))).alias("i", "x"))
    return rounded(out.withColumn("i", F.col("i") + 1), "x", digits=5)


@query("""select 'o_totalprice' as value_name, o_orderstatus, count(o_totalprice) as n_known, min(o_totalprice) as least, max(o_totalprice) as greatest, round(avg(o_totalprice), 4) as mean, round(median(o_totalprice), 4) as median from orders group by 2
union all select 'o_custkey', o_orderstatus, count(*), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4), round(median(o_custkey), 4) from orders group by 2""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.summary(read_table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus"]), "mean", "median", digits=4)


@query("select o_orderpriority, count(*) as n_rows from orders group by 1")
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.value_counts(read_table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator: the first hundred in a stated order."""
    return O.head(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def customers_without_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return O.missing(read_table(spark, sf_dir, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_YEARS = K._CALENDAR.replace("range(2017, 2025)", "range(1995, 2002)")


@query(f"""with {_YEARS} select c.year, c.window_index, count(*) as n_orders, round(avg(o_totalprice), 6) as mean_price from orders join cal c on o_orderdate >= c.start_date and o_orderdate < c.end_date group by 1, 2""")
def orders_in_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.assign_windows(read_table(spark, sf_dir, "orders"), C.windows(spark, range(1995, 2002)), "o_orderdate")
    return rounded(o.groupBy("year", "window_index").agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price")), "mean_price")


@query(f"""with {_YEARS}, shape as (select cast(o_orderdate as date) as d, o_orderkey, o_totalprice from orders where isodow(o_orderdate) = 2 and o_totalprice > 400000),
w as (select year, window_index, cast(start_date - to_days(cast((isodow(start_date) + 5) % 7 as int)) as date) as t from cal)
select year, window_index, cast(t as varchar) as usdm_date, t in (select d from shape) as has_snapshot, count(o_orderkey) as n_polygons, max(o_totalprice) as worst from w left join shape on d = t group by all""")
def drought_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear orders of Tuesdays as drought polygons: a window whose snapshot is missing says so."""
    o = read_table(spark, sf_dir, "orders").where((F.weekday("o_orderdate") == 1) & (F.col("o_totalprice") > 400000))
    shapes = o.select(F.to_date("o_orderdate").alias("snapshot_date"), "o_orderkey", "o_totalprice")
    d = readers.drought_snapshots(shapes, C.windows(spark, range(1995, 2002)).select("year", "window_index", "start_date"))
    return d.groupBy("year", "window_index", F.col("usdm_date").cast("string").alias("usdm_date"), "has_snapshot").agg(F.count("o_orderkey").alias("n_polygons"), F.max("o_totalprice").alias("worst"))


# Panels

_FLAT = f"{K._SCORES}, flat as (select tile_id, window_index, label, 'ndvi_score' as method, ndvi_score as score from cmp union all select tile_id, window_index, label, 'dist_score', dist_score from cmp union all select tile_id, window_index, label, 'gru_score', gru_score from cmp), {K._metric_sql('flat', 'label', 'score', 'method')}, hit as (select flat.*, score >= round(best_threshold, 6) as flagged from flat join metrics using (method))"
_METHODS = ["ndvi_score", "dist_score", "gru_score"]


@query(f"""with {_FLAT}, m as (select distinct method from flat) select m.method, cast(t as int) as true_class, cast(p as int) as predicted_class, count(hit.method) as n from m cross join range(2) a(t) cross join range(2) b(p) left join hit on hit.method = m.method and hit.label = t and hit.flagged = (p = 1) group by all""")
def confusion_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_panels(K._scored(spark, sf_dir), _METHODS)


@query(f"""with {_FLAT} select method, window_index, count(*) filter (where label = 1) as positives, round(count(*) filter (where label = 1 and flagged) / nullif(count(*) filter (where label = 1), 0), 6) as recall from hit group by all""")
def recall_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.recall_panels(K._scored(spark, sf_dir), _METHODS), "recall")


@query(f"""with {K._SCORES}, {TILES}, one as (select * from cmp where window_index = 6), flat as (select 'ndvi_score' as panel, tile_id, ndvi_score::double as value from one union all select 'gru_score', tile_id, gru_score from one union all select 'label', tile_id, label from one),
clip as (select panel, round(quantile_cont(value, 0.05), 6) as low, round(quantile_cont(value, 0.95), 6) as high from flat group by 1)
select p.panel, t.tile_id, t.x, t.y, flat.value, low, high from tiles t cross join (values ('ndvi_score'), ('gru_score'), ('label')) p(panel) left join flat on flat.panel = p.panel and flat.tile_id = t.tile_id left join clip on clip.panel = p.panel""")
def map_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = K._scored(spark, sf_dir).where("window_index = 6")
    return rounded(M.map_panels(tiles(spark, sf_dir), one, ["ndvi_score", "gru_score", "label"]), "low", "high")


# Ledgers


@query("""with log as (select o_custkey as task, o_orderdate as moment, case o_orderstatus when 'F' then 'submitted' when 'O' then 'finished' else case when o_totalprice < 30000 then 'error' else 'moved' end end as event from orders),
by_task as (select task, list(event order by moment, event) as ev from log group by 1),
folded as (select task, list_reduce(list_prepend('PENDING', ev), lambda s, e: case when s = 'PENDING' and e = 'submitted' then 'RUNNING' when s = 'RUNNING' and e = 'finished' then 'DONE' when s = 'DONE' and e = 'moved' then 'SYNCED' when s in ('PENDING', 'RUNNING') and e = 'error' then 'FAILED' else s end) as status from by_task)
select c_custkey as task, coalesce(status, 'PENDING') as status from customer left join folded on task = c_custkey""")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks, their orders as the event log."""
    event = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "O", "finished").when(F.col("o_totalprice") < 30000, "error").otherwise("moved")
    log = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderdate").alias("at"), event.alias("event"))
    ledger = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.lit("PENDING").alias("status"))
    return W.replay(ledger, log, ["task"])


_POLLED = "case o_orderpriority when '1-URGENT' then 'RUNNING' when '2-HIGH' then 'DONE' when '5-LOW' then 'SYNCED' else 'PENDING' end"


@query(f"""with l as (select o_orderkey as task, 't' || o_orderkey as task_id, {_POLLED} as status, o_orderstatus, o_totalprice > 250000 as moved from orders),
r as (select *, case when status = 'RUNNING' then case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'CANCELLED' else 'UNKNOWN' end end as reply from l),
s as (select *, case when status = 'DONE' or reply = 'COMPLETED' then case when moved then 'SYNCED' else 'DONE' end when reply = 'CANCELLED' then 'FAILED' else status end as now from r),
q as (select *, row_number() over (partition by now order by task) as k, greatest(0, 1500 - (select count(*) from s where now = 'RUNNING')) as free from s)
select task, task_id, case when now = 'PENDING' and k <= free then 'RUNNING' else now end as status, case when now = 'SYNCED' and status <> 'SYNCED' then '/done/' || task else '' end as local_path, reply from q""")
def ledger_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of the loop, orders as tasks; replies that are missing are UNKNOWN."""
    o = read_table(spark, sf_dir, "orders")
    ledger = o.select(F.col("o_orderkey").alias("task"), F.concat(F.lit("t"), "o_orderkey").alias("task_id"), F.expr(_POLLED).alias("status"), F.lit("").alias("local_path"))
    replies = o.where("o_orderstatus in ('F', 'O')").select(F.concat(F.lit("t"), "o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("CANCELLED").alias("state"))
    moved = o.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("task"), F.concat(F.lit("/done/"), "o_orderkey").alias("local_path"))
    return W.poll_pass(ledger, replies, moved, cap=1500, key=["task"])


@query("""with u as (select cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as window_index, count(*) as n from orders group by 1, 2)
select year, window_index, case when year = 1995 then 'skipped_done' when window_index = 2 then 'skipped_empty' when window_index = 3 then 'error' else 'ok' end as status,
case when year <> 1995 and window_index not in (2, 3) then n end as n_items, case when year <> 1995 and window_index = 3 then 'ValueError(''no scene in ' || year || ''')' end as error from u""")
def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by year and month: done before 1996, empty in February, failing in March."""
    units = read_table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("window_index")).agg(F.count(F.lit(1)).alias("n"))

    def work(unit: dict) -> int | None:
        if unit["window_index"] == 3:
            raise ValueError(f"no scene in {unit['year']}")
        return None if unit["window_index"] == 2 else int(unit["n"])

    done = units.where("year = 1995").select("year", "window_index")
    return W.work_off(units, work, done, ["year", "window_index"]).drop("elapsed_seconds")
