"""Line deduplication in DataFrame operations only.

Lines are exploded with their positions, normalised and hashed; the distinct documents of each
hash are counted; lines of hashes at or over the threshold are dropped, and the rest is put
together again by position. Only (document, position, hash) rows are shuffled for the counts:
text is moved once, to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lower_ascii, small, written


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE_CHARS)))


def drop_frequent_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key_chars: int = 1, report: bool = False) -> DataFrame:
    """Drops every line whose key is found in at least ``min_docs`` documents.

    Returns the rows of ``docs`` with all their columns and the text replaced; with ``report``
    the columns n_lines, n_dropped and kept_text beside the id instead.

    Defined cases: a null or empty text is one empty line (and stays null in the first form); keys
    of fewer than ``min_key_chars`` code points are never dropped; rows that repeat an id count as
    one document; a null id counts as one document, too; an empty table gives an empty table;
    other columns are carried along and cannot clash, because the work is done on columns with
    names of its own.
    """
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_row"), lines.alias("_lines"))
    # Written once, as normalising costs more than reading a row of four numbers for each line.
    keyed = written(
        base.select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_key_chars)
        # 128 bits, so that equal hashes mean equal keys however many lines there are
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g")),
        "lines",
    )
    # Counting lines first (combined before the shuffle) leaves few hashes for the distinct count.
    often = written(keyed.groupBy("_h", "_g").count().where(F.col("count") >= min_docs).select("_h", "_g"), "line-often")
    hits = keyed.join(small(often), ["_h", "_g"])
    frequent = written(
        hits.select("_h", "_g", "_id").distinct().groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("_h", "_g"),
        "line-frequent",
    )
    drop = (
        keyed.join(small(frequent), ["_h", "_g"])
        .groupBy("_id", "_row")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))
        .select(F.col("_id").alias("_drop_id"), F.col("_row").alias("_drop_row"), "_drop")
    )
    # The text travels as its array of lines, so that it is split once and indexed afterwards.
    others = [c for c in docs.columns if c != text_col]
    named = docs.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("_rest"),
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_row"),
        F.when(F.col(f"`{text_col}`").isNotNull(), lines).alias("_lines"),
    )
    joined = named.join(drop, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_row") == F.col("_drop_row")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    if report:
        return joined.select(
            F.col("_id").alias(id_col),
            F.when(F.col("_lines").isNull(), 1).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
            F.coalesce(kept, F.lit("")).alias("kept_text"),
        )
    place = {c: i for i, c in enumerate(others)}
    return joined.select(*(kept.alias(c) if c == text_col else F.col(f"_rest.c{place[c]}").alias(c) for c in docs.columns))
