"""Problem 7: pack documents into containers of fixed token capacity.

Conflict-constrained best fit. Items are spread evenly over shards by a hash of their id, so no source and no
group of copies makes a shard larger than another, and each shard is packed on its own: texts of many copies first, then the largest items, each
into the tightest open container (found by bisection in the residual-ordered list) whose bitmaps admit it. A
container's bitmaps say which sources and which duplicate clusters it holds: copies of one text never share a
container, and neither do sources named together in ``source_conflicts``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import pieces
from . import tokens as tk

#: Items a shard holds on average; its leftover is at most a few containers, so a larger shard wastes less.
SHARD_ITEMS = 20_000
PACKED = "container_id string, doc_id bigint, piece_no int, n_pieces int, start_pos bigint, end_pos bigint, tokens bigint, source string, used bigint, capacity bigint"


SIZED = "doc_id bigint, source string, cluster string, shard_key bigint, tokens bigint, parts array<struct<start bigint, end bigint, tokens bigint>>"


class Shard:
    """Open containers of one shard, ordered by what is left in them."""

    def __init__(self, capacity: int, conflicts: dict[int, int] | None = None):
        self.capacity, self.conflicts = capacity, conflicts or {}
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.order: list[tuple[int, int]] = []  # (left, container), containers with nothing left drop out

    def place(self, size: int, source: int, cluster: int, copies: int = 1) -> list[int]:
        """Containers for so many copies of one item, what a best fit of one copy after the other would choose."""
        bit, own = 1 << source, (1 << cluster if cluster >= 0 else 0)
        bad = self.conflicts.get(source, 0)
        k, chosen = bisect_left(self.order, (size, -1)), []
        while k < len(self.order) and len(chosen) < copies:
            b = self.order[k][1]
            if self.sources[b] & bad or self.clusters[b] & own:
                k += 1  # the next tightest
                continue
            del self.order[k]
            chosen.append(b)
        while len(chosen) < copies:
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            chosen.append(len(self.left) - 1)
        for b in chosen:
            self.left[b] -= size
            self.sources[b] |= bit
            self.clusters[b] |= own
            if self.left[b] > 0:
                insort(self.order, (self.left[b], b))
        return chosen


def pack(items: Iterable[tuple[int, str, str]], capacity: int, source_conflicts: Iterable[tuple[str, str]] = ()) -> list[int]:
    """Container number of each (size, source, cluster key); sizes are at most capacity.

    Texts of many copies come first, as every copy needs a container of its own that others then fill; then the largest
    items. Ties are broken by source, cluster key and place in the input. An item of size 0 takes any container.
    """
    items = list(items)
    names = {s: i for i, s in enumerate(sorted({x[1] for x in items} | {s for p in source_conflicts for s in p}))}
    bad: dict[int, int] = {}
    for a, b in source_conflicts:
        bad[names[a]] = bad.get(names[a], 0) | 1 << names[b]
        bad[names[b]] = bad.get(names[b], 0) | 1 << names[a]
    groups: dict[tuple, list[int]] = {}
    for i, (size, source, cluster) in enumerate(items):
        groups.setdefault((-size, source, cluster), []).append(i)
    seen: dict[str, int] = {}
    for (_, _, cluster), who in groups.items():
        seen[cluster] = seen.get(cluster, 0) + len(who)
    bits = {c: i for i, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}  # alone: no conflict, no bit
    shard, out = Shard(capacity, bad), [0] * len(items)
    many = lambda c: -seen[c] if seen[c] > 1 else 0
    for (size, source, cluster), who in sorted(groups.items(), key=lambda g: (many(g[0][2]), g[0])):
        for i, b in zip(who, shard.place(-size, names[source], bits.get(cluster, -1), len(who)), strict=True):
            out[i] = b
    return out


def containers(
    docs: DataFrame,
    capacity: int,
    *,
    tokenizer: str = tk.TOKENIZER,
    shard_items: int = SHARD_ITEMS,
    source_conflicts: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """One row per document (per piece of a document over the capacity) with its container.

    Takes doc_id, text and source; other columns are ignored. A null source counts as ''. Null and empty texts are
    items of 0 tokens. Copies are texts equal but for case and white space. A document over the capacity is cut as by
    problem 9, without overlap, into pieces that are packed like any item; start_pos and end_pos say where. An empty input gives an empty result. Rows given
    twice under one doc_id are packed once.
    """

    if capacity <= 0:
        raise ValueError("capacity must be positive")

    def sized(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = [tk.count(x, tokenizer) for x in p.text]
            parts_of = [
                [{"start": a, "end": b, "tokens": t} for a, b, t, _ in pieces.split(x, capacity, 0, tokenizer)] if t > capacity else [{"start": 0, "end": len(x), "tokens": t}] for x, t in zip(p.text, n, strict=True)
            ]
            yield pd.DataFrame({"doc_id": p.doc_id, "source": p.source, "cluster": p.cluster, "shard_key": p.shard_key, "tokens": n, "parts": parts_of})

    base = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select(
        "doc_id",
        "source",
        "text",
        F.md5(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))).alias("cluster"),
        F.xxhash64("doc_id").alias("shard_key"),
    )
    runtime.ship(docs.sparkSession)
    n_docs = docs.count()  # the footer's row count for a table
    shards = max(1, -(-n_docs // shard_items))
    sizes = runtime.spread(base, "shard_key").mapInPandas(sized, SIZED)

    def fill(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["doc_id", "source", "cluster", "tokens"]).drop_duplicates("doc_id")
        rows = []
        for doc, source, cluster, cut in zip(p.doc_id, p.source, p.cluster, p.parts, strict=True):
            rows += [(doc, k, len(cut), x["start"], x["end"], x["tokens"], source, cluster) for k, x in enumerate(cut)]
        where = pack([(r[5], r[6], f"{r[7]}:{r[1]}") for r in rows], capacity, source_conflicts)
        used: dict[int, int] = {}
        for r, b in zip(rows, where, strict=True):
            used[b] = used.get(b, 0) + r[5]
        shard = int(p["shard"].iloc[0])
        return pd.DataFrame(
            [(f"{shard}-{b}", *r[:7], used[b], capacity) for r, b in zip(rows, where, strict=True)],
            columns=["container_id", "doc_id", "piece_no", "n_pieces", "start_pos", "end_pos", "tokens", "source", "used", "capacity"],
        )

    return sizes.withColumn("shard", F.pmod("shard_key", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(fill, PACKED)


def container_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of capacity left unused."""
    bins = packed.groupBy("container_id").agg(F.max("used").alias("used"), F.max("capacity").alias("capacity"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(1 - F.sum("used") / F.sum("capacity"), 6).alias("unused_share"),
    )


def oversized(packed: DataFrame) -> DataFrame:
    """Documents the packing had to split."""
    return packed.where("n_pieces > 1 and piece_no = 0").select("doc_id")
