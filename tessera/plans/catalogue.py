"""The registered queries over the driver's tables, each with its SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import projection as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import attribute as A
from ..operators import compare as M
from ..operators import curves as U
from ..operators import distance as D
from ..operators import embed as E
from ..operators import grid as G
from ..operators import labels as L
from ..operators import ordered as O
from ..operators import raster as R
from ..operators import sequence as Q
from ..operators import union as N
from ..session import read_table, shared_path
from ..sources import readers
from ..streaming import ledger as W
from .inputs import CELLS, COSINE, EDGES, HISTORY, HISTORY_SQL, JUDGED, LABELLED, SCORED, SIDE, TILES, VECTORS, cells, judged, labelled, pixels, tiles, vectors
from .registry import QUERIES, SQL, query, rounded  # noqa: F401

def _text(*names: str):
    return (F.col(n).cast("string").alias(n) for n in names)


# Indices, history and labels


@query("""
with p as (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as window_index, l_tax * 10000 as blue, l_quantity * 200 as red, l_extendedprice / 10 as nir from lineitem),
q as (select *, blue > 0 and blue <= 10000 and red > 0 and red <= 10000 and nir > 0 and nir <= 10000 as ok, blue / 10000 as b, red / 10000 as r, nir / 10000 as n from p)
select tile_id, year, window_index, round(median((n - r) / greatest(n + r, 1e-6)) filter (where ok), 6) as ndvi,
  round(median(greatest(-1.0, least(1.0, 2.5 * (n - r) / greatest(n + 6 * r - 7.5 * b + 1, 1e-6)))) filter (where ok), 6) as evi, round(count(*) filter (where ok) / 64.0, 6) as valid_fraction
from q group by all""")
def cell_median_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r, n = (S.reflectance(F.col(x)) for x in ("blue", "red", "nir"))
    out = L.cell_medians(pixels(spark, sf_dir), S.valid_pixel(F.col("blue"), F.col("red"), F.col("nir")), {"ndvi": S.ndvi(r, n), "evi": S.evi(b, r, n)}, pixels_per_cell=64)
    return rounded(out, "ndvi", "evi", "valid_fraction")


@query(f"""with {CELLS}, {HISTORY_SQL} select tile_id, window_index, round(history_mean, 6) as history_mean, round(history_std, 6) as history_std, history_count from hist""")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.history_stats(cells(spark, sf_dir), "ndvi", HISTORY), "history_mean", "history_std")


@query(f"""with {LABELLED} select tile_id, year, window_index, round(ndvi, 6) as ndvi, round(history_mean, 6) as history_mean, round(history_std, 6) as history_std, history_count, z, label from labelled""")
def labels_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labelled(spark, sf_dir), "ndvi", "history_mean", "history_std")


@query(f"""with {LABELLED} select window_index, count(*) as n, count(*) filter (where label = 1) as stressed, round(avg(ndvi), 6) as mean_value, round(avg(z), 6) as mean_z from labelled group by window_index""")
def labels_summary_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.summarise(labelled(spark, sf_dir)), "mean_value", "mean_z")


# Calendar, names, time


@query("select cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as window_index, cast(min(cast(o_orderdate as date)) as varchar) as date_start from orders group by 1, 2 order by 1, 2")
def windows_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("window_index"), F.to_date("o_orderdate").alias("date_start"))
    return o.groupBy("year", "window_index").agg(F.min("date_start").cast("string").alias("date_start")).orderBy("year", "window_index")


_MONTHS = "case month(s) when 1 then 'jan' when 2 then 'feb' when 3 then 'mar' when 4 then 'apr' when 5 then 'may' when 6 then 'jun' when 7 then 'jul' when 8 then 'aug' when 9 then 'sep' when 10 then 'oct' when 11 then 'nov' when 12 then 'dec' end"
_CALENDAR = f"""cal as (select cast(y as int) as year, cast(i as int) as window_index, cast(s as date) as start_date, cast(s + to_days(cast(d as int)) as date) as end_date, printf('%d_w%02d_%s%02d', y, i, {_MONTHS}, day(s)) as label from (
  select y, k + 1 as i, make_date(y, 4, 1) + to_days(cast(14 * k as int)) as s, 14 as d from range(2017, 2025) a(y), range(14) b(k)
  union all select y, m.i, make_date(y, m.m, 1), 30 from range(2017, 2025) a(y), (values (15, 1), (16, 2), (17, 3), (18, 11), (19, 12)) m(i, m)))"""


@query(f"""with {_CALENDAR} select sensor, c.year, c.window_index, c.label, cast(c.start_date as varchar) as start_date, cast(c.end_date as varchar) as end_date from cal c, (values ('s2'), ('s1')) s(sensor)""")
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = spark.range(1).select(F.explode(F.array(F.lit("s2"), F.lit("s1"))).alias("sensor"))
    return C.windows(spark, range(2017, 2025)).crossJoin(F.broadcast(sensors)).select("sensor", "year", "window_index", "label", *_text("start_date", "end_date"))


@query(f"""with {_CALENDAR} select c.year, c.window_index, count(*) as n_scenes, count(distinct user_id) as n_users, round(avg(value), 6) as mean_value
from events e join cal c on e.ts >= c.start_date and e.ts < c.end_date group by 1, 2""")
def events_in_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.assign_windows(read_table(spark, sf_dir, "events"), C.windows(spark, range(2017, 2025)), "ts")
    return rounded(e.groupBy("year", "window_index").agg(F.count(F.lit(1)).alias("n_scenes"), F.countDistinct("user_id").alias("n_users"), F.avg("value").alias("mean_value")), "mean_value")


@query("""select o_orderkey, cast(cast(o_orderdate as date) as varchar) as day, cast(cast(cast(o_orderdate as date) - to_days(cast((isodow(o_orderdate) + 5) % 7 as int)) as date) as varchar) as tuesday from orders""")
def tuesday_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), C.tuesday_on_or_before(day).cast("string").alias("tuesday"))


@query(f"""with {_CALENDAR} select 's2_' || label || '.tif' as filename, 's2' as sensor, year, window_index, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, cast((year - 2017) * 19 + window_index - 1 as bigint) as global_index from cal""")
def filename_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = C.windows(spark, range(2017, 2025)).select(F.concat(F.lit("s2_"), "label", F.lit(".tif")).alias("filename"))
    p = name.withColumn("p", C.parse_filename(F.col("filename")))
    return p.select("filename", "p.sensor", "p.year", "p.window_index", F.col("p.start_date").cast("string").alias("start_date"), C.label_end(F.col("p.window_index"), F.col("p.start_date")).cast("string").alias("end_date"), C.global_index(F.col("p.year"), F.col("p.window_index"), 2017).cast("bigint").alias("global_index"))


@query("""select event_id, round(sin(2 * pi() * week(ts) / 52), 6) as week_sin, round(cos(2 * pi() * week(ts) / 52), 6) as week_cos, round(sin(radians(user_id % 90)), 6) as lat_sin, round(cos(radians(user_id % 90)), 6) as lat_cos,
round(sin(radians(user_id % 180)), 6) as lon_sin, round(cos(radians(user_id % 180)), 6) as lon_cos from events""")
def time_latlon_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", S.time_vector(F.col("ts")).alias("t"), S.latlon_vector(F.col("user_id") % 90, F.col("user_id") % 180).alias("p"))
    return rounded(e.select("event_id", *(F.col(v)[i].alias(n) for v, i, n in (("t", 0, "week_sin"), ("t", 1, "week_cos"), ("p", 0, "lat_sin"), ("p", 1, "lat_cos"), ("p", 2, "lon_sin"), ("p", 3, "lon_cos")))), "week_sin", "week_cos", "lat_sin", "lat_cos", "lon_sin", "lon_cos")


# Rasters, zones, grids


@query("""
with z as (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, avg(case when l_linenumber in (1, 5) then 1.0 else 0.0 end) as f from lineitem group by all),
m as (select tile_id, avg(f) as mean_frac from z group by 1)
select cast(row_number() over (order by tile_id) as int) as new_id, tile_id, round(mean_frac, 6) as mean_frac from m where mean_frac >= 0.30""")
def threshold_keep_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = R.zonal_fractions(pixels(spark, sf_dir), "scl", {"corn": 1, "soy": 5}, ["tile_id", "year"])
    kept = z.groupBy("tile_id").agg(F.avg(F.col("corn_frac") + F.col("soy_frac")).alias("mean_frac")).where("mean_frac >= 0.30")
    return rounded(O.renumber(kept, "tile_id").withColumn("new_id", F.col("new_id").cast("int")), "mean_frac")


@query("""
with z as (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, count(*) as n_pixels, count(*) filter (where l_linenumber = 1) as a, count(*) filter (where l_linenumber = 5) as b from lineitem group by all)
select tile_id, year, n_pixels, round(a / n_pixels, 6) as corn_frac, round(b / n_pixels, 6) as soy_frac, case when a > b then 1 when b > 0 then 5 else 0 end as modal_class from z""")
def modal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.zonal_fractions(pixels(spark, sf_dir), "scl", {"corn": 1, "soy": 5}, ["tile_id", "year"]), "corn_frac", "soy_frac")


@query("""select cast(l_orderkey % 40 as int) as "row", cast(l_partkey % 40 as int) as col, max(l_linenumber) as scl from lineitem group by 1, 2""")
def mosaic_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mosaic_max(pixels(spark, sf_dir), "scl")


@query("""
select cast(l_orderkey % 40 as int) as "row", cast(l_partkey % 40 as int) as col, cast(trunc(coalesce(median(l_quantity * 200) filter (where l_linenumber not in (0, 1, 3, 8, 9, 10)), 0)) as int) as red,
cast(trunc(coalesce(median(l_extendedprice / 10) filter (where l_linenumber not in (0, 1, 3, 8, 9, 10)), 0)) as int) as nir from lineitem group by 1, 2""")
def temporal_median_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.composite_median(pixels(spark, sf_dir), ["row", "col"], {"red": R.clear(F.col("scl"), F.col("red")), "nir": R.clear(F.col("scl"), F.col("nir"))})


@query("""
select cast(l_orderkey % 40 as int) as "row", cast(l_partkey % 40 as int) as col, round(avg(case when l_quantity > 5 then l_extendedprice / 7000 end), 6) as vv from lineitem group by 1, 2""")
def temporal_mean_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    vv = F.when(F.col("quantity") > 5, F.col("price") / 7000).otherwise(-32768.0)
    return rounded(R.composite_mean(pixels(spark, sf_dir), ["row", "col"], {"vv": R.radar(vv)}), "vv")


_DENSE = """grid as (select cast(l_orderkey % 40 as int) as "row", cast(l_partkey % 40 as int) as col, round(avg(l_quantity), 6) as vv from lineitem group by 1, 2)"""


_MIRROR = """near as (select cast(r.i as int) as o, cast(case when r.i + d.i < 0 then -1 - (r.i + d.i) when r.i + d.i >= 40 then 79 - (r.i + d.i) else r.i + d.i end as int) as src from range(40) r(i), range(-2, 3) d(i))"""


@query(f"""with {_DENSE}, {_MIRROR} select a."row", a.col, round(sum(b.vv) / 25.0, 6) as vv from grid a join near r on r.o = a."row" join near c on c.o = a.col join grid b on b."row" = r.src and b.col = c.src group by 1, 2""")
def focal_mean_5x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = rounded(R.composite_mean(pixels(spark, sf_dir), ["row", "col"], {"vv": F.col("quantity")}), "vv")
    return rounded(R.focal_mean(grid, "vv", shape=(40, 40)), "vv")


@query(f"""with grid as (select cast(year(l_shipdate) as int) as year, cast(l_orderkey % 40 as int) as "row", cast(l_partkey % 40 as int) as col, round(avg(l_quantity), 6) as vv from lineitem group by all), {_MIRROR}
select a.year, a."row", a.col, round(sum(b.vv) / 25.0, 6) as vv from grid a join near r on r.o = a."row" join near c on c.o = a.col join grid b on b.year = a.year and b."row" = r.src and b.col = c.src group by all""")
def focal_mean_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = rounded(R.composite_mean(pixels(spark, sf_dir), ["year", "row", "col"], {"vv": F.col("quantity")}), "vv")
    return rounded(R.focal_mean(grid, "vv", keys=["year"], shape=(40, 40)), "vv")


@query("""
select cast((c // 8) * 5 + r // 8 + 1 as bigint) as tile_id, count(*) as n_pixels, round(avg(case when s = 1 then 1.0 else 0.0 end), 6) as corn_frac, round(avg(q), 6) as mean_quantity
from (select l_orderkey % 40 as r, l_partkey % 40 as c, l_linenumber as s, l_quantity as q from lineitem) group by 1""")
def zonal_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.tile_grid(spark, (0.0, 0.0, 40.0, 40.0), 8.0)
    p = G.points_in_tiles(pixels(spark, sf_dir).drop("tile_id").withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), grid, 8.0)
    out = p.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg(F.when(F.col("scl") == 1, 1.0).otherwise(0.0)).alias("corn_frac"), F.avg("quantity").alias("mean_quantity"))
    return rounded(out, "corn_frac", "mean_quantity")


@query("""select cast(q as int) as quadrant, count(*) as n, round(avg(l_quantity), 6) as mean_quantity from (select ((l_orderkey % 40) // 20) * 2 + (l_partkey % 40) // 20 as q, l_quantity from lineitem) group by 1""")
def quadrant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir).withColumn("quadrant", S.quadrant(F.col("row"), F.col("col"), 20))
    return rounded(p.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.avg("quantity").alias("mean_quantity")), "mean_quantity")


#: Drought polygons: (class, corners).
_DROUGHT = ((0, ((0.0, 0.0), (40000.0, 0.0), (40000.0, 40000.0), (0.0, 40000.0))), (2, ((10000.0, 10000.0), (30000.0, 10000.0), (30000.0, 60000.0), (10000.0, 60000.0))), (3, ((20000.0, 0.0), (45000.0, 0.0), (45000.0, 20480.0))))


def _polygons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, [{"x": x, "y": y} for x, y in ring]) for c, ring in _DROUGHT], "dm int, ring array<struct<x: double, y: double>>")


_DROUGHT_SQL = """case when x >= 20000 and x <= 45000 and y >= 0 and y <= (x - 20000) * 20480.0 / 25000 then 3 when x between 10000 and 30000 and y between 10000 and 60000 then 2 when x between 0 and 40000 and y between 0 and 40000 then 0 end"""


@query(f"""with {TILES} select tile_id, x, y, {_DROUGHT_SQL} as dm from tiles""")
def point_in_polygon_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.points_in_polygons(tiles(spark, sf_dir), _polygons(spark), 2 * SIDE, order=[-F.col("dm")], point_id="tile_id")


@query("""select 0.0::double as min_x, 0.0::double as min_y, 45000.0::double as max_x, 60000.0::double as max_y""")
def polygon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(_polygons(spark))


@query("""
with g as (select i, j, i * 5120.0::double as x0, j * 5120.0::double as y0 from range(10) a(i), range(10) b(j))
select cast(i * 10 + j + 1 as bigint) as tile_id, x0, y0 from g where x0 <= 30000 and x0 + 5120 >= 10000 and y0 <= 45000 and y0 + 5120 >= 10000""")
def tiles_meeting_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.tile_grid(spark, (0.0, 0.0, 51200.0, 51200.0), SIDE)
    return G.tiles_in_polygon(grid, ((10000.0, 10000.0), (30000.0, 10000.0), (30000.0, 45000.0), (10000.0, 45000.0))).select("tile_id", "x0", "y0")


#: A square with a hole and a second part, in tile units: (class, rings).
_HOLED = ((1, (((0, 0), (6, 0), (6, 8), (0, 8)), ((2, 2), (2, 5), (4, 5), (4, 2)), ((8, 1), (10, 1), (10, 3), (8, 3)))),)


def _square(side: float):
    x, y = F.col("x"), F.col("y")
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(x, y), corner(x + side, y), corner(x + side, y + side), corner(x, y + side))


def _plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of one and a half tiles, so that neighbours overlap, by nation."""
    nation = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return tiles(spark, sf_dir).join(nation, "tile_id").withColumn("ring", _square(1.5 * SIDE))


@query(f"""with {TILES} select tile_id, x, y, case when (x between 0 and {6 * SIDE} and y between 0 and {8 * SIDE} and not (x > {2 * SIDE} and x < {4 * SIDE} and y > {2 * SIDE} and y < {5 * SIDE})) or (x between {8 * SIDE} and {10 * SIDE} and y between {SIDE} and {3 * SIDE}) then 1 end as dm from tiles""")
def point_in_holed_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile corners in a record of three rings: an outer one, its hole, and another part."""
    shapes = [(c, [[{"x": x * SIDE, "y": y * SIDE} for x, y in ring] for ring in rings]) for c, rings in _HOLED]
    polygons = spark.createDataFrame(shapes, "dm int, rings array<array<struct<x: double, y: double>>>")
    return G.points_in_polygons(tiles(spark, sf_dir), polygons, 2 * SIDE, order=[F.col("dm")], point_id="tile_id", ring="rings")


@query(f"""with {TILES} select s_nationkey as nation, min(x) as min_x, min(y) as min_y, max(x) + {1.5 * SIDE} as max_x, max(y) + {1.5 * SIDE} as max_y from tiles join supplier on s_suppkey = tile_id group by 1""")
def nation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(_plots(spark, sf_dir), by=["nation"])


@query(f"""with {TILES}, small as (select s_nationkey as nation, cast(x / {SIDE / 2} as bigint) + a.i as cx, cast(y / {SIDE / 2} as bigint) + b.i as cy from tiles join supplier on s_suppkey = tile_id, range(3) a(i), range(3) b(i)),
n as (select s_nationkey as nation, count(*) as n_polygons from supplier group by 1)
select nation, n_polygons, round(count(distinct (cx, cy)) * {SIDE / 2 * SIDE / 2}::double, 3) as area, round(min(cx) * {SIDE / 2}::double, 3) as min_x, round((max(cy) + 1) * {SIDE / 2}::double, 3) as max_y from small join n using (nation) group by all""")
def polygon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each nation's overlapping squares: its area and two of its bounds."""
    u = N.union_polygons(_plots(spark, sf_dir), ["nation"])
    box = G.bounds(u, "rings", ["nation"]).select("nation", F.round("min_x", 3).alias("min_x"), F.round("max_y", 3).alias("max_y"))
    return u.select("nation", "n_polygons", F.round(G.area(F.col("rings")), 3).alias("area")).join(box, "nation")


@query("""select n_nationkey as nation, cast((10 + n_nationkey) * (10 + n_nationkey) - 4.0 * n_regionkey as double) as area, round(((10 + n_nationkey) * (10 + n_nationkey) * (10 + n_nationkey) / 2.0 - 4.0 * n_regionkey * (1 + n_regionkey)) / ((10 + n_nationkey) * (10 + n_nationkey) - 4.0 * n_regionkey), 6) as centre_x,
round(((10 + n_nationkey) * (10 + n_nationkey) * (10 + n_nationkey) / 2.0 - 4.0 * n_regionkey * 2) / ((10 + n_nationkey) * (10 + n_nationkey) - 4.0 * n_regionkey), 6) as centre_y from nation""")
def area_and_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square as wide as the nation's number and ten, with a hole of 2 x region by 2."""
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    k, h, one, zero = F.col("n_nationkey") + 10, 2 * F.col("n_regionkey"), F.lit(1), F.lit(0)
    outer = F.array(corner(zero, zero), corner(k, zero), corner(k, k), corner(zero, k))
    hole = F.array(corner(one, one), corner(one, one + 2), corner(one + h, one + 2), corner(one + h, one))
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.array(outer, hole).alias("rings"))
    return rounded(n.select("nation", G.area(F.col("rings")).alias("area"), G.centroid(F.col("rings")).alias("c")).select("nation", "area", F.col("c.x").alias("centre_x"), F.col("c.y").alias("centre_y")), "centre_x", "centre_y")


@query(f"""with {TILES}, plots as (select x, y from tiles join supplier on s_suppkey = tile_id where s_acctbal > 4000),
g as (select i, j, i * {SIDE}::double as x0, j * {SIDE}::double as y0 from range(10) a(i), range(110) b(j))
select distinct cast(i * 110 + j + 1 as bigint) as tile_id, x0, y0 from g, plots where x0 <= x + {1.5 * SIDE} and x0 + {SIDE} >= x and y0 <= y + {1.5 * SIDE} and y0 + {SIDE} >= y""")
def tiles_meeting_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.tile_grid(spark, (0.0, 0.0, 10 * SIDE, 110 * SIDE), SIDE)
    return G.tiles_in_polygons(grid, _plots(spark, sf_dir).where("balance > 4000").select("ring"), SIDE).select("tile_id", "x0", "y0")


@query("""select cast(year(l_shipdate) as int) as year, count(*) as n_pixels, cast(sum(l_linenumber) as bigint) as total from lineitem
where (l_partkey % 40 between 5 and 29 and l_orderkey % 40 between 5 and 34 and not (l_partkey % 40 between 10 and 19 and l_orderkey % 40 between 10 and 14)) group by 1""")
def pixels_of_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = [[{"x": float(x), "y": float(y)} for x, y in r] for r in (((5, 5), (30, 5), (30, 35), (5, 35)), ((10, 10), (10, 15), (20, 15), (20, 10)))]
    aoi = spark.createDataFrame([(rings,)], "rings array<array<struct<x: double, y: double>>>")
    p = pixels(spark, sf_dir).withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5})
    return G.clip_to_polygons(p, aoi, 8.0, ring="rings").groupBy("year").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("scl").alias("total"))


@query("""with px as (select cast(l_orderkey % 40 as int) as r, cast(l_partkey % 40 as int) as c, max(l_linenumber) as v from lineitem group by 1, 2),
places as (select cast(ti * 3 + tj + 1 as bigint) as tile_id, cast(k * 8 + i as int) as place, ti * 16 + 2 * i + 1 as x, (tj + 1) * 16 - 2 * k - 1 as y from range(3) a(ti), range(3) b(tj), range(8) c(i), range(8) d(k))
select tile_id, place, cast(coalesce(v, 0) as double) as value from places left join px on px.c = x and px.r = y""")
def tile_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of 16 x 16 pixels resampled to 8 x 8; the last tiles reach beyond the raster."""
    p = R.mosaic_max(pixels(spark, sf_dir), "scl").select(F.lit(1).alias("band"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), F.col("scl").cast("double").alias("value"))
    grid = G.tile_grid(spark, (0.0, 0.0, 48.0, 48.0), 16.0)
    return R.chips(p, grid, 1.0, size=8).select("tile_id", F.posexplode("chip").alias("place", "value"))


@query("""with p as (select cast(year(l_shipdate) as int) as year, (l_orderkey % 400) / 10.0::double as x, (l_partkey % 400) / 10.0::double as y, l_quantity as v from lineitem),
g as (select *, cast(floor(x) as int) as col, cast(floor(40 - y) as int) as "row" from p), k as (select *, (x - (col + 0.5)) * (x - (col + 0.5)) + (y - (40 - ("row" + 0.5))) * (y - (40 - ("row" + 0.5))) as away from g where "row" between 0 and 39 and col between 0 and 39)
select year, "row", col, v as value from k qualify row_number() over (partition by year, "row", col order by round(away, 9), x, y, v) = 1""")
def scenes_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), ((F.col("l_orderkey") % 400) / 10.0).alias("x"), ((F.col("l_partkey") % 400) / 10.0).alias("y"), F.col("l_quantity").alias("value"))
    return R.regrid(li, (0.0, 40.0), 1.0, (40, 40), ["year"], digits=9)


@query("""with px as (select cast(year(l_shipdate) as int) as composite, cast(l_orderkey % 40 as int) as r, cast(l_partkey % 40 as int) as c, max(l_linenumber) as v, max(l_quantity) as w from lineitem group by all),
every as (select composite, ti * 3 + tj + 1 as tile_id, ti * 16 + i as x, tj * 16 + k as y from (select distinct composite from px), range(3) a(ti), range(3) b(tj), range(16) c(i), range(16) d(k))
select e.composite, cast(tile_id as bigint) as tile_id, round(avg((coalesce(v, 0) - 3.0) / 2.0), 4) as band_1, round(avg((coalesce(w, 0) - 25.0) / 8.0), 4) as band_2 from every e left join px on px.composite = e.composite and px.r = y and px.c = x group by all""")
def composite_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From yearly composites of two bands to tile vectors, by an encoder that can be followed."""
    p = pixels(spark, sf_dir).groupBy(F.col("year").alias("composite"), "row", "col").agg(F.max("scl").cast("double").alias("v"), F.max("quantity").alias("w"))
    bands = F.explode(F.array(F.struct(F.lit(1).alias("band"), F.col("v").alias("value")), F.struct(F.lit(2).alias("band"), F.col("w").alias("value"))))
    p = p.select("composite", F.make_date("composite", F.lit(4), F.lit(1)).alias("day"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), bands.alias("b")).select("composite", "day", "x", "y", "b.*")
    grid = G.tile_grid(spark, (0.0, 0.0, 48.0, 48.0), 16.0).withColumns({"lat": F.lit(42.0), "lon": F.lit(-93.0)})
    stats = spark.createDataFrame([(1, 3.0, 2.0), (2, 25.0, 8.0)], "band int, mean double, std double")  # by powers of two, so that means are exact
    e = E.embed_composites(p, grid, stats, E.PatchMeans(2, 4), pixel=1.0, size=16)
    return rounded(e.select("composite", "tile_id", F.col("embedding")[0].cast("double").alias("band_1"), F.col("embedding")[1].cast("double").alias("band_2")), "band_1", "band_2", digits=4)


@query(f"with {TILES}, {EDGES} select tile_id, nbr_id from edges")
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_edges(tiles(spark, sf_dir), 8192.0)


# Attribution and agreement

_NEIGHBOURS = f"""{LABELLED}, {TILES}, {EDGES},
nb as (select e.tile_id, l.year, l.window_index, count(*) as k from labelled l join edges e on e.nbr_id = l.tile_id where l.label = 1 group by all)"""


@query(f"""with {_NEIGHBOURS} select l.tile_id, l.year, l.window_index, coalesce(nb.k, 0) as n_stressed_neighbours from labelled l left join nb using (tile_id, year, window_index) where l.label = 1 and l.year = 2000""")
def stressed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir).where(F.col("year") == SCORED)
    out = A.stressed_neighbours(lab, G.neighbour_edges(tiles(spark, sf_dir), 8192.0))
    return out.where("label = 1").select("tile_id", "year", "window_index", "n_stressed_neighbours")


@query(f"""with {CELLS} select c.tile_id, c.year, c.window_index, round(p.ndvi - c.ndvi, 6) as drop_recent from cells c left join cells p on p.tile_id = c.tile_id and p.year = c.year and p.window_index = c.window_index - 2""")
def lookback_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.lookback(cells(spark, sf_dir), "ndvi").select("tile_id", "year", "window_index", "drop_recent"), "drop_recent")


_ATTRIBUTED = f"""{_NEIGHBOURS},
radar as (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as window_index, median(case when l_quantity > 5 then round(-l_quantity / 2, 6) end) as vv_db from lineitem group by all),
att as (select l.tile_id, l.year, l.window_index, l.label, l.z, round(r.vv_db, 6) as vv_db, t.dm as usdm_class, round(p.ndvi - l.ndvi, 6) as drop_recent, coalesce(nb.k, 0) as k
  from labelled l left join radar r using (tile_id, year, window_index) left join nb using (tile_id, year, window_index)
  left join cells p on p.tile_id = l.tile_id and p.year = l.year and p.window_index = l.window_index - 2
  left join (select tile_id, {_DROUGHT_SQL} as dm from tiles) t on t.tile_id = l.tile_id),
cat as (select *, coalesce(usdm_class, -1) >= 2 as is_drought, coalesce(vv_db < -20, false) as is_flooded, coalesce(drop_recent > 0.05, false) as is_sudden, k < 2 as is_isolated from att),
cats as (select *, case when is_flooded then 'flood' when is_sudden and not is_isolated then 'climatic_event_or_frost' when is_sudden and is_isolated then 'local_field' when is_drought then 'drought' else 'other_unknown' end as category from cat)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = A.stressed_neighbours(labelled(spark, sf_dir), G.neighbour_edges(tiles(spark, sf_dir), 8192.0))
    floor = F.when(F.col("quantity") > 5, F.round(-F.col("quantity") / 2, 6)).otherwise(-32768.0)
    out = A.lookback(lab, "ndvi").join(A.radar_medians(pixels(spark, sf_dir), R.radar(floor)), list(L.CELL), "left")
    dry = point_in_polygon_left(spark, sf_dir).select("tile_id", F.col("dm").alias("usdm_class"))
    return A.categorise(rounded(out.join(dry, "tile_id", "left"), "vv_db", "drop_recent"), sudden_above=0.05)


@query(f"""with {_ATTRIBUTED} select tile_id, year, window_index, usdm_class, vv_db, drop_recent, k as n_stressed_neighbours, is_drought, is_flooded, is_sudden, is_isolated, category from cats where label = 1 and year = 2000""")
def attribute_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _attributed(spark, sf_dir).where((F.col("label") == 1) & (F.col("year") == SCORED))
    return out.select("tile_id", "year", "window_index", "usdm_class", "vv_db", "drop_recent", "n_stressed_neighbours", "is_drought", "is_flooded", "is_sudden", "is_isolated", "category")


@query(f"""with {_ATTRIBUTED} select window_index, count(*) filter (where category = 'flood') as flood, count(*) filter (where category = 'climatic_event_or_frost') as climatic_event_or_frost, count(*) filter (where category = 'local_field') as local_field,
count(*) filter (where category = 'drought') as drought, count(*) filter (where category = 'other_unknown') as other_unknown from cats where label = 1 group by 1""")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_counts(_attributed(spark, sf_dir).where("label = 1"), ["window_index"])


@query(f"""with {JUDGED}, m as (select count(*) filter (where quality = 0 and dry) as tp, count(*) filter (where quality = 1 and dry) as fp, count(*) filter (where quality = 0 and not dry) as fn, count(*) filter (where quality = 1 and not dry) as tn
from (select *, coalesce(case when toxic = 1 then 2 end, -1) >= 2 as dry from judged)),
r as (select *, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as r from m)
select tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / greatest(p + r, 1e-12), 6) as f1 from r""")
def confusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    dry = F.coalesce(F.when(F.col("toxic") == 1, 2), F.lit(-1)) >= 2
    return rounded(U.confusion(j, F.col("quality") == 0, dry), "precision", "recall", "f1")


def _metric_sql(src: str, label: str, score: str, by: str = "") -> str:
    """The curve metrics in SQL: common table expressions up to ``metrics``."""
    key, part, tail = (f"{by}, ", f"partition by {by} ", f" group by {by}") if by else ("", "", "")
    return f"""pts as (select {key}{score} as score, sum({label}) as p, count(*) as n from {src} where {label} is not null and {score} is not null group by {key}{score}),
cum as (select *, sum(p) over ({part}order by score desc) as tp, sum(n) over ({part}order by score desc) as pp, sum(p) over ({part}) as pos, sum(n) over ({part}) as total from pts),
det as (select *, case when total > pos and pos > 0 then (n - p) / (total - pos) * ((tp - p) + tp) / 2 / pos end as auc, case when pos > 0 then p / pos * (tp / pp) end as ap,
  round(2 * (tp / pp) * coalesce(tp / nullif(pos, 0), 0) / greatest(tp / pp + coalesce(tp / nullif(pos, 0), 0), 1e-12), 12) as f, tp / pp as pr, coalesce(tp / nullif(pos, 0), 0) as re from cum),
metrics as (select {key}cast(max(total) as bigint) as n, cast(max(pos) as bigint) as positives, round(sum(auc), 6) as roc_auc, round(sum(ap), 6) as average_precision,
  round(arg_max(score, {{'f': f, 's': -score}}), 6) as best_threshold, round(max(f), 6) as best_f1, round(arg_max(pr, {{'f': f, 's': -score}}), 6) as precision, round(arg_max(re, {{'f': f, 's': -score}}), 6) as recall from det{tail})"""


_METRICS = ("roc_auc", "average_precision", "best_threshold", "best_f1", "precision", "recall")


@query(f"""with {LABELLED}, {TILES}, known as (select case when t.dm >= 2 then 1 else 0 end as y, -l.z as s, l.label, t.dm from labelled l join (select tile_id, {_DROUGHT_SQL} as dm from tiles) t using (tile_id) where l.label in (0, 1)),
inside as (select y, s from known where dm is not null), {_metric_sql("inside", "y", "s")},
m as (select count(*) filter (where label = 1 and coalesce(dm, -1) >= 2) as tp, count(*) filter (where label = 0 and coalesce(dm, -1) >= 2) as fp, count(*) filter (where label = 1 and coalesce(dm, -1) < 2) as fn, count(*) filter (where label = 0 and coalesce(dm, -1) < 2) as tn from known)
select tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as drought_precision_of_labels, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as drought_recall_of_labels,
round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as label_precision_of_drought, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as label_recall_of_drought, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1, roc_auc from m, metrics""")
def agreement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    dry = point_in_polygon_left(spark, sf_dir).select("tile_id", F.col("dm").alias("usdm_class"))
    joined = labelled(spark, sf_dir).join(dry, "tile_id").withColumn("score", -F.col("z"))
    out = A.drought_agreement(joined)
    return rounded(out, "drought_precision_of_labels", "drought_recall_of_labels", "label_precision_of_drought", "label_recall_of_drought", "f1", "roc_auc")


# Curve metrics


@query(f"with {JUDGED}, {_metric_sql('judged', 'toxic', 'score')} select n, positives, roc_auc from metrics")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.binary_metrics(judged(spark, sf_dir), "toxic", "score").select("n", "positives", "roc_auc"), "roc_auc")


@query(f"with {JUDGED}, {_metric_sql('judged', 'toxic', 'score')} select average_precision from metrics")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.binary_metrics(judged(spark, sf_dir), "toxic", "score").select("average_precision"), "average_precision")


@query(f"with {JUDGED}, {_metric_sql('judged', 'toxic', 'score', 'grp')} select grp, best_threshold, best_f1, precision, recall from metrics")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = U.binary_metrics(judged(spark, sf_dir), "toxic", "score", ["grp"]).select("grp", "best_threshold", "best_f1", "precision", "recall")
    return rounded(m, "best_threshold", "best_f1", "precision", "recall")


@query(f"with {JUDGED}, {_metric_sql('judged', 'toxic', 'score')} select score, round((pp - tp) / (total - pos), 6) as fpr, round(tp / pos, 6) as tpr from det")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.curve_points(judged(spark, sf_dir), "toxic", "score").select("score", "fpr", "tpr"), "fpr", "tpr")


@query(f"with {JUDGED}, {_metric_sql('judged', 'toxic', 'score')} select score, round(tp / pos, 6) as recall, round(tp / pp, 6) as precision from det")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.curve_points(judged(spark, sf_dir), "toxic", "score").select("score", F.col("tpr").alias("recall"), "precision"), "recall", "precision")


@query(f"with {JUDGED} select grp, count(*) filter (where toxic = 1) as positives, round(count(*) filter (where toxic = 1 and score >= 1000) / nullif(count(*) filter (where toxic = 1), 0), 6) as recall from judged group by 1")
def recall_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.recall_by(judged(spark, sf_dir), "toxic", "score", 1000.0, ["grp"]), "recall")


@query("select count(*) as n, count(*) filter (where toxic = 1) as positives, round(count(*) filter (where toxic = 1) / count(*), 6) as prevalence, round(greatest(count(*) filter (where toxic = 0), 1) / greatest(count(*) filter (where toxic = 1), 1), 6) as pos_weight from labels")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.class_balance(read_table(spark, sf_dir, "labels"), "toxic"), "prevalence", "pos_weight")


# Vectors and distances

_HIST = "hm as (select label, list(m order by i) as mv, max(n) as n from (select label, i, avg(v[i]) as m, count(*) as n from (select label, v, unnest(range(1, len(v) + 1)) as i from vecs) group by all) group by 1)"


@query(f"with {VECTORS}, {_HIST} select label, n as n_history, cast(i as int) as i, round(mv[i], 6) as mean from (select label, n, mv, unnest(range(1, len(mv) + 1)) as i from hm)")
def history_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.mean_vector(vectors(spark, sf_dir), ["label"], "embedding")
    return rounded(m.select("label", F.col("n").alias("n_history"), F.posexplode("mean_vector").alias("i", "mean")).withColumn("i", F.col("i") + 1), "mean")


@query(f"with {VECTORS}, {_HIST} select q.vec_id, q.label, coalesce(hm.n, 0) as n_history, round({COSINE.format(a='q.v', b='hm.mv')}, 6) as distance from vecs q left join hm using (label)")
def cosine_to_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(D.distance_to_history(v, v, ["label"]).select("vec_id", "label", "n_history", "distance"), "distance")


@query(f"""with {VECTORS}, pairs as (select a.vec_id, list_concat(a.v, b.v) as x, list_concat(b.v, a.v) as y, least(a.label, b.label) as n from vecs a join vecs b on b.vec_id = a.vec_id + 1)
select vec_id, cast(n as int) as n_both, round({COSINE.format(a='x', b='y')}, 6) as distance from pairs""")
def concat_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    x = V.cosine_distance(F.concat("embedding", "other"), F.concat("other", "embedding"))
    return rounded(a.join(b, "vec_id").select("vec_id", F.least("label", "other_label").alias("n_both"), x.alias("distance")), "distance")


@query("""with s as (select i, avg(x) as m, stddev_samp(x) as sd from (select unnest(range(1, len(embedding) + 1)) as i, unnest(embedding::double[]) as x from embeddings) group by 1)
select vec_id, cast(s.i as int) as i, round((e.x - s.m) / s.sd, 5) as x from (select vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding::double[]) as x from embeddings) e join s using (i)""")
def band_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    stats = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("b")).select(F.col("b.m").alias("mean"), F.col("b.s").alias("std"))  # one row a band
    out = v.crossJoin(F.broadcast(packed)).select("vec_id", F.posexplode(V.normalise(F.col("embedding"), F.col("mean"), F.col("std"))).alias("i", "x"))
    return rounded(out.withColumn("i", F.col("i") + 1), "x", digits=5)


@query("""with a as (select vec_id, round(embedding[1]::double, 6) as s2_dist from embeddings where embedding[1] > 0), b as (select vec_id, round(embedding[2]::double, 6) as s1_dist from embeddings where embedding[2] > 0), c as (select vec_id, round(embedding[3]::double, 6) as combined_dist from embeddings where embedding[3] > 0)
select vec_id, s2_dist, s1_dist, combined_dist from a full join b using (vec_id) full join c using (vec_id)""")
def distances_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    # A vector has a distance of a kind where that element is positive.
    part = lambda i, name: v.where(F.col("embedding")[i] > 0).select("vec_id", F.round(F.col("embedding")[i].cast("double"), 6).alias(name))
    return D.merge_distances(part(0, "s2_dist"), part(1, "s1_dist"), part(2, "combined_dist"), ["vec_id"])


# Comparison and maps

_SCORES = f"""{LABELLED}, base as (select tile_id, year, window_index, round(-ndvi, 6) as ndvi_score from labelled),
gru as (select tile_id, year, window_index, round(1 / (1 + exp(z)), 6) as gru_score from labelled where z is not null),
dist as (select tile_id, year, window_index, round(abs(z), 3) as dist_score from labelled where history_count > 2),
cmp as (select l.tile_id, l.year, l.window_index, l.label, ndvi_score, dist_score, gru_score from labelled l left join base using (tile_id, year, window_index) left join dist using (tile_id, year, window_index) left join gru using (tile_id, year, window_index)
  where l.year = 2000 and l.label in (0, 1) and ndvi_score is not null and dist_score is not null and gru_score is not null)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    base = lab.withColumn("s", F.round(-F.col("ndvi"), 6))
    dist = lab.where("history_count > 2").withColumn("s", F.round(F.abs("z"), 3))
    gru = lab.where("z is not null").withColumn("s", F.round(S.sigmoid(-F.col("z")), 6))
    return M.side_by_side(lab.select("tile_id", "year", "window_index", "label"), {"ndvi_score": (base, "s"), "dist_score": (dist, "s"), "gru_score": (gru, "s")}, year=SCORED)


@query(f"with {_SCORES} select * from cmp")
def compare_three_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"with {_SCORES}, flat as (select label, 'ndvi_score' as method, ndvi_score as score from cmp union all select label, 'dist_score', dist_score from cmp union all select label, 'gru_score', gru_score from cmp), {_metric_sql('flat', 'label', 'score', 'method')} select * from metrics")
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.compare(_scored(spark, sf_dir), ["ndvi_score", "dist_score", "gru_score"]), *_METRICS)


@query(f"with {LABELLED} select tile_id, cast(coalesce(sum(case when -ndvi >= 0.1 then 1 else 0 end), 0) as bigint) as n_flagged from labelled where year = 2000 group by 1")
def flag_count_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir).where(F.col("year") == SCORED).withColumn("s", -F.col("ndvi"))
    return M.flag_counts(lab, "s", 0.1)


@query(f"with {CELLS} select year, round(quantile_cont(ndvi::double, 0.05), 6) as low, round(quantile_cont(ndvi::double, 0.95), 6) as high from cells group by 1")
def percentile_clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.clip_range(cells(spark, sf_dir), "ndvi", by=["year"]), "low", "high")


@query(f"with {LABELLED}, {TILES} select t.tile_id, t.x, t.y, round(l.ndvi, 6) as ndvi, l.label from tiles t left join (select * from labelled where year = 2000 and window_index = 6) l using (tile_id)")
def map_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir).where((F.col("year") == SCORED) & (F.col("window_index") == 6)).select("tile_id", "ndvi", "label")
    return rounded(M.map_table(tiles(spark, sf_dir), lab), "ndvi")


# Sets, ledgers, sequences


@query("""select 'early' as period, o_orderpriority, count(*) as n from orders where year(o_orderdate) < 1997 group by 2 union all select 'late', o_orderpriority, count(*) from orders where year(o_orderdate) >= 1997 group by 2
union all select 'customers without orders', '', count(*) from (select c_custkey from customer except select o_custkey from orders)""")
def union_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    part = lambda name, cond: o.where(cond).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("period"), "o_orderpriority", "n")
    rest = read_table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customers without orders").alias("period"), F.lit("").alias("o_orderpriority"), "n")
    return part("early", F.year("o_orderdate") < 1997).unionByName(part("late", F.year("o_orderdate") >= 1997)).unionByName(rest)


@query("""with planned as (select o_orderkey, 'PENDING' as status, '' as task_id from orders), old as (select o_orderkey, case o_orderstatus when 'F' then 'FAILED' when 'O' then 'SYNCED' else 'RUNNING' end as status, 't' || o_custkey as task_id from orders where year(o_orderdate) < 2000)
select p.o_orderkey, case when o.status is null or o.status = 'FAILED' then 'PENDING' else o.status end as status, case when o.status is null or o.status = 'FAILED' then '' else o.task_id end as task_id from planned p left join old o using (o_orderkey)""")
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    planned = o.select("o_orderkey", F.lit("PENDING").alias("status"), F.lit("").alias("task_id"))
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SYNCED").otherwise("RUNNING")
    old = o.where(F.year("o_orderdate") < 2000).select("o_orderkey", status.alias("status"), F.concat(F.lit("t"), "o_custkey").alias("task_id"))
    return W.merge(planned, old, ["o_orderkey"])


@query("select case o_orderstatus when 'F' then 'FAILED' when 'O' then 'SYNCED' else 'RUNNING' end as status, count(*) as n from orders group by 1")
def ledger_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SYNCED").otherwise("RUNNING")
    return W.status_counts(read_table(spark, sf_dir, "orders").withColumn("status", status))


@query("""with d as (select tile_id, year, step from (select distinct l_suppkey as tile_id, cast(year(l_shipdate) as int) as year from lineitem), range(1, 20) s(step))
select d.tile_id, d.year, cast(d.step as int) as step, coalesce(case when c.n > 0 then c.l end, -1) as label, coalesce(c.l in (0, 1), false) as valid from d left join (select l_suppkey as tile_id, cast(year(l_shipdate) as int) as year, month(l_shipdate) as step, max(l_linenumber) % 2 as l, count(*) as n from lineitem group by all) c
on c.tile_id = d.tile_id and c.year = d.year and c.step = d.step""")
def sequence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = pixels(spark, sf_dir).groupBy("tile_id", "year", "window_index").agg((F.max("scl") % 2).alias("label"), F.array(F.avg("quantity"), F.avg("price")).alias("embedding"))
    seq = Q.dense_sequences(facts, C.WINDOWS_PER_YEAR, 2)
    return seq.select("tile_id", "year", F.explode("seq").alias("s")).select("tile_id", "year", "s.step", "s.label", "s.valid")


# Ordered operators


@query(f"with {JUDGED} select doc_id, grp, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / 2 as mid_rank from judged")
def mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mid_rank(judged(spark, sf_dir), "score", ["grp"]).select("doc_id", "grp", "mid_rank")


@query("""select o_custkey, o_orderkey, max(o_totalprice) over w as best, coalesce(o_totalprice > max(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), true) as is_best
from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row)""")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.best_so_far(read_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", ["o_custkey"]).select("o_custkey", "o_orderkey", "best", "is_best")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.first_of_key(o, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("select o_orderkey, row_number() over (order by o_orderkey) as new_id from orders where o_orderpriority = '1-URGENT'")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.renumber(read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey"), "o_orderkey")


@query(f"""with {CELLS} select tile_id, year, {", ".join(f'min(ndvi) filter (where window_index = {w}) as "{w}"' for w in range(1, 13))} from cells group by all""")
def pivot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pivot_first(cells(spark, sf_dir), ["tile_id", "year"], "window_index", range(1, 13), "ndvi")


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read_table(spark, sf_dir, "customer").select("c_custkey")
    return O.missing(wanted, read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query()
def reprojected_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile corners, in metres of UTM zone 15, as degrees and in the crop raster's projection."""
    t = tiles(spark, sf_dir).select("tile_id", P.from_utm(F.col("x") + 420_000, F.col("y") + 4_600_000, 15).alias("p"))
    return rounded(t.select("tile_id", "p.lon", "p.lat", P.to_albers(F.col("p.lon"), F.col("p.lat")).alias("a")).select("tile_id", "lon", "lat", "a.x", "a.y"), "lon", "lat", "x", "y")


# Sources


@query("""select event_type, count(*) as n from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-15' and value < 80 and user_id % 100 <= 60 and user_id % 100 + 5 >= 20 group by 1""")
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    scenes = e.select("event_type", F.col("ts"), (F.col("user_id") % 100).alias("min_x"), (F.col("user_id") % 100 + 5).alias("max_x"), F.lit(0).alias("min_y"), F.lit(1).alias("max_y"), F.col("value").alias("cloud_cover"))
    return readers.scene_search(scenes, (20, 0, 60, 1), "2024-01-05", "2024-01-15", 80.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, 'https://x/' || event_id as return_url, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def xml_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    reply = F.concat(F.lit("<r><returnURL>https://x/"), F.col("event_id").cast("string"), F.lit("</returnURL></r>"))
    return e.select("event_id", readers.xml_value(reply, "//returnURL").alias("return_url"), F.from_json("props", "struct<k: bigint>")["k"].alias("k"))


# Streams and models


@query("select cast(cast(ts as date) as varchar) as day, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished exports: batches merge into a ledger of counts by type and day."""
    source = f"{sf_dir}/events.parquet"
    out, checkpoint = shared_path(spark, "ledger"), shared_path(spark, "ledger-checkpoint")

    def work(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # repeating a batch replaces it

    # A stream's source is a folder or a pattern; this one names a single file.
    W.drain(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(source).schema, checkpoint, work)
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    n = 19
    facts = v.select(F.expr(f"vec_id div {n}").alias("tile_id"), F.lit(SCORED).alias("year"), (F.col("vec_id") % n + 1).alias("window_index"), "embedding", (F.col("label") >= 8).cast("int").alias("label"))
    return Q.dense_sequences(facts, n, 64)


@query()
def gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _sequences(spark, sf_dir)
    fold = F.pmod(F.xxhash64("tile_id", "year"), F.lit(8))  # one of eight sequences chooses the epoch
    net = Q.fit_gru(seq.where(fold > 0), watched=seq.where(fold == 0))
    return rounded(Q.score_gru(seq, net), "p_stressed")


@query()
def encoder_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips are whole embeddings, by a stand-in encoder."""
    v = vectors(spark, sf_dir).select(F.expr("vec_id div 4").alias("chip_id"), F.col("embedding").cast("array<double>").alias("pixels"), F.array(F.lit(0.5), F.lit(1.0)).alias("meta"))
    return E.pool_quadrants(E.embed(v, E.RandomProjection(32)), ["chip_id"])


from . import round_trips  # noqa: E402, F401 - registers its queries, which build on those above
