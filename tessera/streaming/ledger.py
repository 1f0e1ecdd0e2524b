"""The work ledger: planned work merged with what is done, and a resumable loop over new files.

An extension beyond batch parity: the polling loop is a Structured Streaming job that stops when
nothing new is there (AvailableNow), with its in-flight cap as files a batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import window_label, windows

KEY = ("sensor", "year", "window_label")
LEDGER = T.StructType([T.StructField("sensor", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("window_label", T.StringType()), T.StructField("drive_filename", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("local_path", T.StringType())])


def plan(spark: SparkSession, years: Sequence[int], sensors: Sequence[str] = ("s2", "s1"), only_year: int | None = None, only_label: str | None = None) -> DataFrame:
    """Sensor by calendar window, all PENDING: a cross join of two small dimensions."""
    calendar = windows(spark, [y for y in years if only_year in (None, y)]) if any(only_year in (None, y) for y in years) else windows(spark, [0]).where("false")
    calendar = calendar.where(F.col("label") == only_label) if only_label else calendar
    names = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in sensors))).alias("sensor"))
    label = window_label(F.col("year"), F.col("window_index"), F.col("start_date"))
    return calendar.crossJoin(F.broadcast(names)).select("sensor", F.col("year").cast("int").alias("year"), label.alias("window_label"), F.concat_ws("_", "sensor", label).alias("drive_filename"), F.lit("").alias("task_id"), F.lit("PENDING").alias("status"), F.lit("").alias("local_path"))


def merge(planned: DataFrame, ledger: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Planned rows with the state the ledger has for them; FAILED ones are PENDING again, with
    no task; unknown ones stay as planned."""
    state = [c for c in planned.columns if c not in key]
    old = ledger.select(*key, F.struct(*state).alias("_old"))
    out = planned.join(old, list(key), "left")
    failed = F.col("_old.status") == "FAILED"
    pick = {c: F.when(F.col("_old").isNull(), F.col(c)).when(failed, F.lit("PENDING") if c == "status" else F.lit("") if c == "task_id" else F.col(f"_old.{c}")).otherwise(F.col(f"_old.{c}")) for c in state}
    return out.select(*key, *(pick[c].alias(c) for c in state))


def remaining(planned: DataFrame, done: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Resume: what has no result yet."""
    return planned.join(done, list(key), "left_anti")


def advance(status, event):
    """The next status of a task on an event (submitted, finished, moved, error); an unknown
    event or one that does not apply leaves it, to be tried again."""
    return (
        F.when((status == "PENDING") & (event == "submitted"), "RUNNING")
        .when((status == "RUNNING") & (event == "finished"), "DONE")
        .when((status == "DONE") & (event == "moved"), "SYNCED")
        .when(status.isin("PENDING", "RUNNING") & (event == "error"), "FAILED")
        .otherwise(status)
    )


def replay(ledger: DataFrame, events: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The ledger after an event log (key, at, event): each task's events, of which it has a few, are
    applied in the order of ``at``, then of their names. A task without events stays as it is, events
    of unknown tasks are passed over, null events are none."""
    log = events.where("event is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("_log"))
    joined = ledger.join(log, list(key), "left")
    after = F.aggregate(F.coalesce("_log.event", F.array().cast("array<string>")), F.col("status"), lambda s, e: advance(s, e))
    return joined.withColumn("status", after).select(*ledger.columns)


def poll_pass(ledger: DataFrame, replies: DataFrame, moved: DataFrame, cap: int = 6, key: Sequence[str] = KEY) -> DataFrame:
    """One pass of the loop. Adds ``reply``, what the service says of a RUNNING task: UNKNOWN where it
    says nothing (an error is passed on as no reply); such a task stays RUNNING and is asked again.
    COMPLETED is DONE, FAILED and CANCELLED are FAILED; DONE tasks whose files are in ``moved`` (key,
    local_path) are SYNCED, others are tried again; then PENDING tasks run, in the order of their
    keys, while fewer than ``cap`` do. replies: (task_id, state)."""
    one = replies.groupBy("task_id").agg(F.max("state").alias("_state"))
    got = ledger.join(one, "task_id", "left").join(moved.select(*key, F.col("local_path").alias("_to")), list(key), "left")
    running = F.col("status") == "RUNNING"
    got = got.withColumn("reply", F.when(running, F.coalesce("_state", F.lit("UNKNOWN"))))
    got = got.withColumn("status", F.when(running & (F.col("reply") == "COMPLETED"), "DONE").when(running & F.col("reply").isin("FAILED", "CANCELLED"), "FAILED").otherwise(F.col("status")))
    synced = (F.col("status") == "DONE") & F.col("_to").isNotNull()
    got = got.withColumns({"local_path": F.when(synced, F.col("_to")).otherwise(F.col("local_path")), "status": F.when(synced, "SYNCED").otherwise(F.col("status"))})
    # At most ``cap`` tasks are chosen, by a top-n that each task of the job cuts first.
    free = got.where("status = 'RUNNING'").limit(cap).agg((F.lit(cap) - F.count(F.lit(1))).alias("_free"))
    first = got.where("status = 'PENDING'").select(*key).orderBy(*key).limit(cap).withColumn("_n", F.row_number().over(Window.orderBy(*key)))
    start = first.crossJoin(F.broadcast(free)).where("_n <= _free").select(*key, F.lit(True).alias("_go"))  # a few rows
    got = got.join(F.broadcast(start), list(key), "left")
    return got.withColumn("status", F.when(F.col("_go"), "RUNNING").otherwise(F.col("status"))).select(*ledger.columns, "reply")


def work_off(units: DataFrame, work: Callable[[dict], int | None], done: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Works off units of work in parallel, a row each, and tells how each went: the key, ``status``,
    ``n_items``, ``error`` and ``elapsed_seconds``.

    ``skipped_done``: its key is in ``done``; it is not worked on. ``skipped_empty``: ``work`` returned
    None. ``ok``: it returned the number of items. ``error``: it raised; the others go on. ``work``
    gets the unit as a dictionary and must bear being repeated, as a lost task is.
    """
    todo = units if done is None else remaining(units, done, key)
    names = list(units.columns)
    schema = ", ".join(f"`{units.schema[k].name}` {units.schema[k].dataType.simpleString()}" for k in key) + ", status string, n_items long, error string, elapsed_seconds double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for values in part[names].itertuples(index=False, name=None):
                unit, began = dict(zip(names, values)), time.monotonic()
                try:
                    n = work(unit)
                    result = ("skipped_empty", None, None) if n is None else ("ok", int(n), None)
                except Exception as e:
                    result = ("error", None, repr(e))
                rows.append((*(unit[k] for k in key), *result, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=[*key, "status", "n_items", "error", "elapsed_seconds"])

    out = todo.repartition(*key).mapInPandas(run, schema)
    if done is None:
        return out
    skipped = units.join(done, list(key), "left_semi").select(*key, F.lit("skipped_done").alias("status"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("elapsed_seconds"))
    return out.unionByName(skipped)


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def drain(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, work: Callable[[DataFrame, int], None], max_files: int = 6) -> int:
    """Works off all files that are there and not yet worked off, at most ``max_files`` a batch;
    returns the number of batches. A batch that fails is repeated from the checkpoint, so ``work``
    must be idempotent by batch number."""
    numbers: set[int] = set()

    def counted(batch: DataFrame, number: int) -> None:
        work(batch, number)
        numbers.add(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(numbers)
