"""Problem 8: mix sources to target weights.

Weighted fair queueing: the documents of a source, in a shuffled order that depends only on seed and id, get the
virtual finish time (tokens of the source up to and with this document) / weight; a further pass over a small source
adds the source's total. All documents are range-sorted by finish time and cut where the budget is used up.

The running sums are taken in two levels (sums of hash ranges first), so no source is ever one task. Where the cut
lies follows from the sources' totals alone, since before time t a source has sent min(t * weight, its supply).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from . import tokens as tk

#: Rows of one range of the shuffled order, on average.
RANGE_ROWS = 20_000


def finish_cut(weights: list[float], supplies: list[float], budget: float) -> float:
    """Time at which the queues together have sent budget tokens (or all they have)."""
    live = sorted((s / w, w) for w, s in zip(weights, supplies, strict=True) if w > 0)
    sent, before, rate = 0.0, 0.0, sum(w for _, w in live)
    for until, w in live:
        if sent + (until - before) * rate >= budget:
            return before + (budget - sent) / rate
        sent, before, rate = sent + (until - before) * rate, until, rate - w
    return before


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    budget: int | None = None,
    seed: int = 17,
    tokenizer: str = tk.TOKENIZER,
    range_rows: int = RANGE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(the mix, the report). The mix has doc_id, source, pass_no, tokens, finish, in global order of finish.

    docs needs doc_id, source and text; targets source, target_share and max_repeats (one row per source: a small
    settings table, which is the only thing read to the driver). The budget is the tokens of all documents unless
    given. Documents of sources without a positive share, or without source, are left out of the mix. Null or
    empty texts count 0 tokens and are left out too. A null max_repeats is 1. Rows under one doc_id count once (the greatest source and
    size). A source whose documents are used up leaves its room to the others in proportion to their weights; ``short`` in
    the report says that it holds less than its share of the budget.
    """
    spark = docs.sparkSession
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats)) for r in goal.collect() if r.source is not None}
    runtime.ship(spark)
    counted = runtime.spread(docs.select("doc_id", "source", "text"), "doc_id").select("doc_id", "source", tk.token_count(F.col("text"), tokenizer).alias("tokens"))
    once = counted.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r"))
    sized = runtime.stored(once.select("doc_id", "r.source", "r.tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h")), "p8-sizes")
    per_source = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).where(F.col("source").isin(list(want)))
    everything = sized.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total, n = int(everything.t or 0), int(everything.n)
    have = {r.source: int(r.tokens) for r in per_source.collect()}  # at most one row per target
    budget = total if budget is None else budget
    used = {s: (w, r) for s, (w, r) in want.items() if w > 0 and r > 0 and have.get(s, 0) > 0}
    until = finish_cut([w for w, _ in used.values()], [float(have[s] * r) for s, (w, r) in used.items()], float(budget))

    plan = spark.createDataFrame(
        [(s, w, r, min(r, int(until * w / have[s]) + 1), have[s]) for s, (w, r) in used.items()],
        "source string, weight double, max_repeats int, passes int, source_tokens bigint",
    )
    ranges = max(1, -(-n // range_rows))
    # the hash's place among equal ranges of the 64-bit line
    ranged = sized.join(runtime.small(plan), "source").withColumn("rng", F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    sums = ranged.groupBy("source", "rng").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "rng", (F.sum("t").over(Window.partitionBy("source").orderBy("rng")) - F.col("t")).alias("before"))
    inside = Window.partitionBy("source", "rng").orderBy("h", "doc_id")
    queued = (
        ranged.join(before, ["source", "rng"])
        .withColumn("cum", F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("finish", (F.col("pass_no") * F.col("source_tokens") + F.col("cum")) / F.col("weight"))
        .where((F.col("finish") <= F.lit(until)) & (F.col("tokens") > 0))
    )
    mixed = queued.select("doc_id", "source", F.col("pass_no").cast("int").alias("pass_no"), "tokens", "finish")
    actual = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("pass_no").alias("last_pass"))
    mixed_tokens = F.coalesce("mixed_tokens", F.lit(0))
    report = (
        spark.createDataFrame([(s, w, r, have.get(s, 0)) for s, (w, r) in want.items()], "source string, target_share double, max_repeats int, source_tokens bigint")
        .join(actual, "source", "left")
        .select(
            "source",
            "target_share",
            "max_repeats",
            "source_tokens",
            mixed_tokens.alias("mixed_tokens"),
            F.coalesce(F.col("last_pass") + 1, F.lit(0)).alias("passes"),
            F.round(mixed_tokens / F.sum(mixed_tokens).over(Window.partitionBy()), 6).alias("actual_share"),
            # used as often as it may be, and still under its share
            (F.col("source_tokens") * F.col("max_repeats") < F.col("target_share") * F.lit(float(budget))).alias("short"),
        )
    )
    return mixed.orderBy("finish", "source", "doc_id", "pass_no"), report
