"""The calendar of observation windows: 14 biweekly ones from April 1, then five of 30 days.

The index is not chronological (15 to 17 are January to March), windows do not cover the year, and
the February one overlaps March's first days; both facts are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS_PER_YEAR = 19
# The months whose first days start the 30-day windows, in order of their index.
MONTHLY = (1, 2, 3, 11, 12)


def windows(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    """Rows (year, window_index, label, start_date, end_date); the end is exclusive."""
    y = spark.range(len(years)).select(F.element_at(F.array(*(F.lit(int(v)) for v in years)), (F.col("id") + 1).cast("int")).alias("year"))
    spring = F.sequence(F.make_date("year", F.lit(4), F.lit(1)), F.make_date("year", F.lit(10), F.lit(8)), F.expr("interval 14 days"))
    biweekly = y.select("year", F.posexplode(spring).alias("i", "start_date")).select("year", (F.col("i") + 1).alias("window_index"), "start_date", F.date_add("start_date", 14).alias("end_date"))
    monthly = y.select("year", F.posexplode(F.array(*(F.make_date("year", F.lit(m), F.lit(1)) for m in MONTHLY))).alias("i", "start_date")).select(
        "year", (F.col("i") + 15).alias("window_index"), "start_date", F.date_add("start_date", 30).alias("end_date")
    )
    return biweekly.unionByName(monthly).select("year", "window_index", window_label(F.col("year"), F.col("window_index"), F.col("start_date")).alias("label"), "start_date", "end_date")


def window_label(year: Column, index: Column, start: Column) -> Column:
    return F.format_string("%d_w%02d_%s", year.cast("int"), index.cast("int"), F.lower(F.date_format(start, "MMMdd")))


def parse_label(label: Column) -> Column:
    """struct<year, window_index, start_date>; null where the label is not one."""
    part = lambda i: F.regexp_extract(label, r"^(\d{4})_w(\d{2})_([a-z]{3})(\d{2})$", i)
    day = F.to_date(F.concat(part(1), F.initcap(part(3)), part(4)), "yyyyMMMdd")
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("year"), part(2).cast("int").alias("window_index"), day.alias("start_date")))


def parse_filename(name: Column) -> Column:
    """struct<sensor, year, window_index, start_date> of s1_... or s2_... .tif; null otherwise."""
    inner = parse_label(F.regexp_extract(name, r"^s[12]_(.+)\.tif$", 1))
    return F.when(inner.isNotNull(), F.struct(F.substring(name, 1, 2).alias("sensor"), inner["year"].alias("year"), inner["window_index"].alias("window_index"), inner["start_date"].alias("start_date")))


def label_end(index: Column, start: Column) -> Column:
    return F.date_add(start, F.when(index <= 14, 14).otherwise(30))


def tuesday_on_or_before(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 7), "TU")


def global_index(year: Column, index: Column, base_year: int) -> Column:
    return (year - base_year) * WINDOWS_PER_YEAR + (index - 1)


def assign_windows(facts: DataFrame, calendar: DataFrame, ts: str) -> DataFrame:
    """A row for each fact and each window that holds it (two at the start of March). The
    calendar, a few rows a year, is exploded into days, so that the range join is an equi-join."""
    days = calendar.select("year", "window_index", F.explode(F.sequence("start_date", F.date_sub("end_date", 1))).alias("_day"))
    return facts.withColumn("_day", F.to_date(ts)).join(F.broadcast(days) if calendar.count() <= 10_000 else days, "_day").drop("_day")
