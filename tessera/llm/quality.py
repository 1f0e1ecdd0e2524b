"""Quality rules by host.

Each document is measured once; the failures are added up by host, and the host's failure rate is
shrunk with a beta prior fitted to the hosts (method of moments, each host one observation, so that
the verdict on a host does not depend on how large the corpus is). The verdict goes back to the
documents: a host with a high rate loses all of them; one with a low rate vouches for its documents,
which then need only pass the base rules; of the others those that fail any rule go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small, written
from .textops import NOT_SPACE, byte_set, chunks, grams, within, words

SYMBOLS = byte_set(b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """A document fails a rule if ... (all in whole numbers, so that results are exact)."""

    min_words: int = 50  # ... it has fewer words
    max_repeat_percent: int = 50  # ... more of its words are in repeated 3-word windows
    window: int = 3
    max_symbol_percent: int = 50  # ... it has more symbols for each hundred words
    max_word_chars: int = 20  # ... its words are longer on average
    max_host_rate: float = 0.8  # hosts with a higher shrunk failure rate are rejected
    vouch_rate: float = 0.1  # hosts with at most this shrunk rate vouch for their documents


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(text: pa.Array, window: int = 3) -> dict[str, np.ndarray]:
    """The five measures of each text of a column, over whole texts."""
    out = {m: np.zeros(len(text), np.int64) for m in MEASURES}
    for lo, hi, data, offsets in chunks(text):
        w = words(data, offsets)
        n = np.diff(w.first)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(NOT_SPACE[data] & ((data & 0xC0) != 0x80), out=total[1:])
        out["word_chars"][lo:hi] = np.diff(total[offsets])
        np.cumsum(SYMBOLS[data], out=total[1:])
        out["n_symbols"][lo:hi] = np.diff(total[offsets])
        out["n_words"][lo:hi] = n
        whole = within(w.doc, window)
        code = grams(w.hash, window)
        repeated = np.zeros(len(w.hash), bool)
        starts = np.flatnonzero(whole)
        if len(starts):
            # the same window in another document is another window
            order = np.lexsort((code[starts], w.doc[starts]))
            key, doc = code[starts][order], w.doc[starts][order]
            same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
            twice = np.zeros(len(starts), bool)
            twice[1:] |= same
            twice[:-1] |= same
            first = starts[order[twice]]
            for j in range(window):
                repeated[first + j] = True
        count = np.zeros(len(repeated) + 1, np.int64)
        np.cumsum(repeated, out=count[1:])
        out["n_repeat_words"][lo:hi] = np.diff(count[w.first])
    for i, x in enumerate(text.to_pylist()):
        if x and "\n" in x:
            out["n_dup_lines"][i] = _duplicate_lines(x)
    return out


def base_failed(m, rules: Rules):
    """On arrays and on columns alike."""
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def any_failed(m, rules: Rules):
    return base_failed(m, rules) | (100 * m["n_symbols"] > rules.max_symbol_percent * m["n_words"]) | (m["word_chars"] > rules.max_word_chars * m["n_words"])


def host_verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """From rows of (host, failed): a row for each host with its counts, its shrunk rate, and whether
    it is rejected or vouches for its documents. Failures are summed before the shuffle, so a hot host
    costs nothing.

    The prior beta(a, b) has the mean m of the hosts' rates; a + b follows from how much the rates vary
    beyond what chance alone gives. Hosts that don't vary get the strongest prior (a + b = 10000); one
    host alone, too. A null host is a host; no rows give no hosts.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    p = F.col("f") / F.col("n")
    moments = hosts.agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("spread"), F.avg(1 / F.col("n")).alias("chance"))
    own = F.col("m") * (1 - F.col("m"))
    between = F.col("spread") - own * F.col("chance")
    size = F.when(between > own / 10001, own / between - 1).otherwise(F.lit(10000.0))
    prior = moments.select("m", F.greatest(F.lit(0.0), size).alias("s"))
    shrunk = (F.col("f") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "f", shrunk.alias("rate"), (shrunk > rules.max_host_rate).alias("rejected"), (shrunk <= rules.vouch_rate).alias("vouches"))  # one row


def _measured_rows(rules: Rules, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(column(b, "text"), rules.window)
            yield pa.RecordBatch.from_arrays([column(b, "id").cast(schema.field("id").type), column(b, "host"), *(pa.array(m[x]) for x in MEASURES), pa.array(base_failed(m, rules)), pa.array(any_failed(m, rules))], schema=schema)

    return run


def host_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Returns id, the five measures, base_failed, failed (any rule), host, host_rate and kept, a
    row for each row of ``docs``.

    Defined cases: a null or empty text has no words and fails; a null host is a host of its own;
    repeated rows are measured and counted each; an empty table gives an empty one; other columns
    are not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{host_col}`").cast("string").alias("host"))
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), *((m, pa.int64()) for m in MEASURES), ("base_failed", pa.bool_()), ("failed", pa.bool_())])
    measured = written(picked.mapInArrow(_measured_rows(rules, schema), "id long, host string, " + "".join(f"{m} long, " for m in MEASURES) + "base_failed boolean, failed boolean"), "quality")
    hosts = written(host_verdicts(measured, rules), "quality-hosts").withColumnRenamed("host", "_host")
    kept = ~F.col("base_failed") & ~F.col("rejected") & (F.col("vouches") | ~F.col("failed"))
    return measured.join(small(hosts), F.col("host").eqNullSafe(F.col("_host")), "left").select(
        F.col("id").alias(id_col), *MEASURES, "base_failed", kept.alias("kept"), "failed", "host", F.col("rate").alias("host_rate")
    )


def keep_good_hosts(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``host_quality`` keeps, with their columns. The texts are not
    shuffled: a first pass sums failures by host, a second measures again and filters in place.

    Defined cases: as in ``host_quality``; null and empty texts go; a row with a null id is judged like
    any other; rows that repeat stay or go together; an empty table stays empty; columns may have any
    names.
    """
    host = F.col(f"`{host_col}`").cast("string")
    schema = pa.schema([("host", pa.string()), ("failed", pa.bool_())])
    flag = "_failed"
    while flag in docs.columns:
        flag += "_"

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "host"), pa.array(any_failed(measure(column(b, "text"), rules.window), rules))], schema=schema)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(column(b, text_col), rules.window)
            yield b.append_column(flag, pa.array(any_failed(m, rules))).filter(pa.array(~base_failed(m, rules)))

    failed = docs.select(host.alias("host"), F.col(f"`{text_col}`").alias("text")).mapInArrow(failures, "host string, failed boolean")
    strict = host_verdicts(failed, rules).where("rejected or not vouches").select(F.col("host").alias("_host"), F.col("rejected").alias("_rejected"))
    strict = written(strict, "quality-hosts")
    left = docs.mapInArrow(good, T.StructType([*docs.schema, T.StructField(flag, T.BooleanType())]))
    return left.join(small(strict), host.eqNullSafe(F.col("_host")) & (F.col("_rejected") | F.col(flag)), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
