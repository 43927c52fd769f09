"""Choosing material under a character budget, in order of rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from .ordered import Ordered


def prefix(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int, gap: int = 0) -> DataFrame:
    """Rows of each key as long as they fit the budget, up to the first that doesn't; ``gap`` counts between rows."""
    o = Ordered(rows.withColumn("__s", F.coalesce(size, F.lit(0))), keys, order).running_sum("used", F.col("__s") + gap)
    o.df = o.df.withColumn("over", F.when(F.col("used") - gap > budget, 1).otherwise(0))
    return o.running_sum("n_over", F.col("over")).df.where("n_over = 0").select(*rows.columns, F.col("used").cast("bigint").alias("used"))


def concatenated(rows: DataFrame, keys: list[str], order: list[str], text: str, limit: int, per_item: int | None = None) -> DataFrame:
    """Texts cut to ``per_item`` characters, then to what is left of the limit; what is past it is left out."""
    cut = F.substring(text, 1, per_item) if per_item else F.col(text)
    o = Ordered(rows.withColumn(text, cut).where(F.length(text) > 0), keys, order).running_sum("before", F.length(text), exclusive=True)
    left = F.lit(limit) - F.col("before")
    return o.df.where(left > 0).select(*[c for c in rows.columns if c != text], F.substring(text, F.lit(1), left.cast("int")).alias(text))


def greedy(items: DataFrame, keys: list[str], rank: str, size: str, limit: int, block: int = 10_000) -> DataFrame:
    """Items taken in order of rank, skipping those that don't fit; the first of a key is always taken.

    Each step depends on the one before, so the fold runs over (rank, size) alone, in blocks of the next items that
    still fit what is left of each key: a block is bounded, and few are needed, as what is left shrinks.
    """
    slim = runtime.stored(items.select(*keys, rank, F.coalesce(size, F.lit(0)).cast("bigint").alias("__n")), "greedy")
    state = runtime.cut(slim.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("used"), F.lit(None).cast(dict(slim.dtypes)[rank]).alias("last")))
    taken = None
    while True:
        fits = F.col("last").isNull() | ((F.col(rank) > F.col("last")) & (F.col("used") < limit) & (F.col("used") + F.col("__n") <= limit))
        order = Window.partitionBy(*keys).orderBy(rank)
        nxt = slim.join(state, keys).where(fits).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= block)
        steps = F.aggregate(
            F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col("__n").alias("n")))),
            F.struct(F.first("used").alias("used"), F.expr("cast(array() as array<struct<rank:" + dict(slim.dtypes)[rank] + ",n:bigint>>)").alias("got"), F.first("last").isNull().alias("fresh")),
            lambda acc, x: F.when(
                acc["fresh"] | ((acc["used"] < limit) & (acc["used"] + x["n"] <= limit)),
                F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["got"], x).alias("got"), F.lit(False).alias("fresh")),
            ).otherwise(acc),
        )
        done = runtime.cut(nxt.groupBy(*keys).agg(steps.alias("s"), F.max(rank).alias("__end")))
        if done.isEmpty():
            break
        got = done.select(*keys, F.explode("s.got").alias("__g")).select(*keys, F.col("__g.rank").alias(rank))
        taken = got if taken is None else taken.unionByName(got)
        state = runtime.cut(state.join(done.select(*keys, F.col("s.used").alias("__u"), "__end"), keys, "left").select(*keys, F.coalesce("__u", "used").alias("used"), F.coalesce("__end", "last").alias("last")))
    return items.join(taken, [*keys, rank], "leftsemi") if taken is not None else items.where(F.lit(False))
