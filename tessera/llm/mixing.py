"""Mixing sources to target weights, in DataFrame operations only.

A token budget is propagated down a tree (domain, language, source, ...). At each node it is
shared among the children by weight; a child that cannot use its share (its documents, repeated
for at most the allowed epochs, are too few) passes the rest to its siblings, and only what the
whole family cannot use goes to the family's own siblings. A leaf's budget buys whole epochs and a
prefix of one more, in an order seeded by the epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

DIGITS = (2, 4, 6)  # hexadecimal digits of the order that name a bucket: 256 in each step


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(value: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in sorted(weights.items()):
        out = F.when(value == name, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)))


def leaf_budgets(leaves: DataFrame, names: Sequence[str], weights: Sequence[Mapping[str, float]], budget: float | Column, max_epochs: int) -> DataFrame:
    """From a row for each leaf (its path in ``names``, and tokens) to the same rows with budget.

    Children in order of capacity for each unit of weight: as long as the budget gives the next
    one, at equal shares a unit, its whole capacity, it gets just that; the rest share by weight.
    """
    depth = len(names)
    weighed = leaves
    for k in range(depth):
        weighed = weighed.withColumn(f"w{k}", _weight(F.col(names[k]), weights[k]))
    can = reduce(lambda x, y: x & y, (F.col(f"w{k}") > 0 for k in range(depth)))
    weighed = weighed.withColumn("cap", F.when(can, F.col("tokens") * float(max_epochs)).otherwise(0.0))
    whole = weighed.agg(F.sum("cap").alias("cap"), F.sum("tokens").cast("double").alias("tokens"))
    given = whole.select(F.least("cap", budget if isinstance(budget, Column) else F.lit(float(budget))).alias("given"))
    for k in range(depth):
        path = list(names[: k + 1])
        nodes = weighed.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w{k}").alias("w"))
        if k == 0:
            nodes = nodes.crossJoin(F.broadcast(given))  # one row
        else:
            up = given.select(*(F.col(n).alias(f"_{n}") for n in path[:-1]), "given")
            nodes = nodes.join(up, _same(path[:-1], [f"_{n}" for n in path[:-1]]), "inner")
        family = Window.partitionBy(*([F.col(n) for n in path[:-1]] or [F.lit(0)]))
        nodes = nodes.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(0.0))
        order = family.orderBy("ratio", F.col(path[-1]).asc_nulls_first())
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(after))
        nodes = nodes.withColumn("unit", F.when(F.col("open") > 0, (F.col("given") - F.col("used")) / F.col("open")).otherwise(0.0))
        nodes = nodes.withColumn("full", F.col("ratio") <= F.col("unit"))
        share = F.first(F.when(~F.col("full"), F.col("unit")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        given = nodes.withColumn("share", share).select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("w") * F.col("share")))).alias("given"))
    named = given.select(*(F.col(n).alias(f"_{n}") for n in names), F.floor("given").cast("long").alias("budget"))
    return leaves.join(named, _same(names, [f"_{n}" for n in names])).select(*names, "tokens", "budget")


def order_key(ident: Column, seed: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, *, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, share: float = 0.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Returns the rows of ``docs`` that are selected, with all columns and, behind them, mix_path
    (the values of the levels, from the root), mix_tokens (words) and mix_copies (in how many
    epochs the document is taken).

    ``levels`` names the levels of the tree from the root and gives their columns; ``weights``
    gives weights to values of a level (1 to values not named; 0 takes none). The budget is in
    tokens, or the ``share`` of all tokens. A leaf whose budget is b and whose documents have n
    tokens takes all of them b div n times, and of epoch b div n the documents in order of
    md5(seed|epoch|id) as long as their sum stays within b mod n.

    Defined cases: a null level value is a value of its own with weight 1; null and empty texts
    have no tokens, and are taken with the prefix they stand in; a leaf without tokens takes
    none; rows that repeat an id have the same place in the order and are taken or left together;
    a null id is ordered as an empty one; an empty table gives an empty one; columns of docs may
    have any names but the three that are added.
    """
    names = [f"_l{k}" for k in range(len(levels))]
    weights = [(weights or {}).get(k, {}) for k in levels]
    path = [c.cast("string").alias(n) for n, c in zip(names, levels.values())]
    flat = written(docs.select(F.col(f"`{id_col}`").alias("_id"), n_tokens(F.col(f"`{text_col}`")).alias("_n"), *path), "mix")
    leaves = flat.groupBy(*names).agg(F.sum("_n").alias("tokens"))
    wanted = F.lit(float(budget)) if budget is not None else F.floor(F.col("tokens") * share)
    plan = leaf_budgets(leaves, names, weights, wanted, max_epochs).where("tokens > 0 and budget > 0")
    plan = written(plan.select(*(F.col(n).alias(f"_{n}") for n in names), F.expr("budget div tokens").alias("_epochs"), (F.col("budget") % F.col("tokens")).alias("_rest")), "mix-plan")
    up = [f"_{n}" for n in names]
    # The prefix: sums by bucket first, then within the one bucket where it ends by finer buckets,
    # and last the order of the rows that are left.
    key = order_key(F.col("_id"), seed, F.col("_epochs"))
    keyed = flat.join(small(plan.where("_rest > 0")), _same(names, up)).select(*up, "_rest", "_n", key.alias("_key"))
    last = keyed.withColumn("_before", F.lit(0).cast("long")).withColumn("_end", F.lit(""))
    for digits in DIGITS:
        bucket = F.substring("_key", 1, digits)
        upto = Window.partitionBy(*up).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = last.groupBy(*up, "_rest", "_before", bucket.alias("_bucket")).agg(F.sum("_n").alias("_n")).withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
        end = written(sums.where("_upto > _rest").groupBy(*up).agg(F.min("_bucket").alias("_end"), F.min_by(F.col("_upto") - F.col("_n"), "_bucket").alias("_before")), "mix-end")
        end = end.select(*(F.col(n).alias(f"e{n}") for n in up), "_end", "_before")
        last = keyed.join(small(end), _same(up, [f"e{n}" for n in up]) & (bucket == F.col("_end")))
    order = Window.partitionBy(*up).orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("_upto", F.col("_before") + F.sum("_n").over(order)).groupBy(*up).agg(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_key"))).alias("_cut"), F.first("_end").alias("_end"))
    cut = cut.select(*(F.col(n).alias(f"c{n}") for n in up), F.coalesce("_cut", "_end").alias("_cut"))  # a bucket's name sorts before its keys
    # Without a bucket where the sum exceeds the rest nothing would be left out; that is an epoch.
    final = written(plan.join(cut, _same(up, [f"c{n}" for n in up]), "left").select(*up, "_epochs", F.coalesce("_cut", F.lit("")).alias("_cut")), "mix-final")
    taken = F.col("_epochs") + F.when(order_key(F.col(f"`{id_col}`"), seed, F.col("_epochs")) <= F.col("_cut"), 1).otherwise(0)
    return (
        docs.withColumns(dict(zip(names, (c.cast("string") for c in levels.values()))))
        .join(small(final), _same(names, up))
        .withColumn("mix_path", F.array(*names))
        .withColumn("mix_tokens", n_tokens(F.col(f"`{text_col}`")))
        .withColumn("mix_copies", taken)
        .where("mix_copies > 0")
        .select(*(F.col(f"`{c}`") for c in docs.columns), "mix_path", "mix_tokens", "mix_copies")
    )
