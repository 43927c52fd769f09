"""Many strings looked for in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Letters of the strings that one pass over the texts looks for.
PASS_CHARS = 4_000_000


def passes(strings: DataFrame) -> int:
    """How many passes the strings (k) take."""
    total = strings.agg(F.sum(F.length("k"))).first()[0] or 0
    return -(-int(total) // PASS_CHARS)


def occurrences(texts: DataFrame, strings: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, k, n): how often each string (k, whole) occurs in each text (doc_id, low), without overlaps.

    With ``whole`` no Latin letter or digit may stand beside it. The strings go to the texts in blocks of PASS_CHARS,
    each in an automaton that reads a text once; empty strings and null texts have no occurrence.
    """
    strings = runtime.stored(strings.where("k != ''").select("k", "whole").distinct(), "strings")
    blocks = passes(strings) if blocks is None else blocks
    texts = runtime.spread(texts.select("doc_id", "low").where(F.length("low") > 0), "doc_id")
    schema = texts.select("doc_id", F.lit("").alias("k"), F.lit(0).cast("bigint").alias("n")).schema
    out = texts.sparkSession.createDataFrame([], schema)
    block = F.pmod(F.xxhash64("k"), F.lit(max(1, blocks)))
    for b in range(blocks):
        rows = [(r.k, r.whole) for r in strings.where(block == b).collect()]
        out = out.unionByName(texts.mapInPandas(counter(texts.sparkSession.sparkContext.broadcast(rows)), schema))
    return out


def counter(shared):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for k, whole in shared.value:
            auto.add_word(k, (k, whole))
        auto.make_automaton()
        edge = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for p in parts:
            rows = []
            for doc, low in zip(p.doc_id, p.low, strict=True):
                seen: dict[str, list[int]] = {}  # how often, and where the last one ended
                for last, (k, whole) in auto.iter(low):
                    a, b = last + 1 - len(k), last + 1
                    if whole and (a and low[a - 1] in edge or b < len(low) and low[b] in edge):
                        continue
                    n = seen.setdefault(k, [0, 0])
                    if a >= n[1]:
                        n[0] += 1
                        n[1] = b
                rows += [(doc, k, n) for k, (n, _) in seen.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "k", "n"])

    return run
