"""Problem 9: cut texts over a token limit at natural boundaries, with an overlap.

Each text is encoded once; prefix sums give every token's end as a character offset. A sorted boundary array per
strength (blank line, line, sentence, clause or word) is searched by bisection for the last boundary under the
limit; a strength counts if it fills the piece at least half, the strongest such wins, and with none the cut is hard.
The next piece begins ``overlap`` tokens before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from . import tokens as tk

#: Boundaries from strongest to weakest; a piece ends where a match ends.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？；][”’」』）]*\s*")),
    ("word", re.compile(r"[,;:]\s+|[，、：]|\s+")),
)
#: Least part of the limit a piece cut at a boundary fills, before a weaker boundary is tried.
FILL = 0.5
PIECE = "doc_id bigint, piece_no int, start_pos bigint, end_pos bigint, tokens int, cut string, text string"


def split(text: str, limit: int, overlap: int, tokenizer: str = tk.TOKENIZER) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, kind of cut) of each piece; a text within the limit is one piece, cut 'whole'."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    at = tk.ends(text, tokenizer)
    n = len(at)
    if n <= limit:
        return [(0, len(text), n, "whole")]
    marks = [(kind, np.unique(np.fromiter((m.end() for m in rx.finditer(text)), dtype=np.int64))) for kind, rx in BOUNDARIES]
    out, first, start = [], 0, 0
    while True:
        if n - first <= limit and (size := tk.count(text[start:], tokenizer)) <= limit:
            out.append((start, len(text), size, "end"))
            return out
        room = limit
        while True:
            hard = int(at[min(first + room, n) - 1])
            least, end, how = int(at[min(first + max(int(room * FILL), overlap + 1), n) - 1]), hard, "hard"
            for kind, ends in marks:
                k = bisect_right(ends, hard) - 1
                if k >= 0 and ends[k] > least:
                    end, how = int(ends[k]), kind
                    break
            size = tk.count(text[start:end], tokenizer)  # a cut inside a word may cost a token or two more
            if size <= limit or room <= overlap + 2:
                break
            room -= size - limit
        out.append((start, end, size, how))
        last = int(np.searchsorted(at, end, side="right"))  # tokens that end by the cut
        first = max(first + 1, last - overlap)
        while first < last and int(at[first - 1]) <= start:
            first += 1
        start = int(at[first - 1]) if overlap else end  # a boundary may lie inside a token


def pieces(docs: DataFrame, limit: int, overlap: int, *, tokenizer: str = tk.TOKENIZER) -> DataFrame:
    """The ordered pieces of each document over the limit: one row per piece.

    Takes doc_id and text; other columns are ignored. Null, empty and short texts give no rows (they stay whole).
    A document given twice is cut twice. Pieces overlap by ``overlap`` tokens of the whole text's encoding (fewer
    only where a character would be torn). An empty table gives an empty result.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for doc, text in zip(p.doc_id, p.text, strict=True):
                got = split(text, limit, overlap, tokenizer)
                if len(got) > 1:
                    rows += [(doc, k, a, b, n, how, text[a:b]) for k, (a, b, n, how) in enumerate(got)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_pos", "end_pos", "tokens", "cut", "text"])

    # a token is at least a byte: shorter texts cannot be over the limit and never reach Python
    return runtime.spread(docs.select("doc_id", "text").where(F.octet_length("text") > limit), "doc_id").mapInPandas(cut, PIECE)
