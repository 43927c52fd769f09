"""Token counts and token offsets by a public tokenizer that lies outside the repository."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor; every operator takes another path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in blocks of about this many characters, so one long text costs linear time.
BLOCK = 20_000

_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of this Python worker, loaded once."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: Places at which the pattern always parts a text: before white space, and where letters or digits meet signs.
_PARTED = regex.compile(r"\s(?=\S)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=\p{N})(?=[^\s\p{N}])")


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Cut text into blocks that are encoded on their own as in the whole.

    Only where a whole block is one word or one run of signs is that run cut.
    """
    at = 0
    while len(text) - at > size:
        end = at + size
        for begin in (at + size * 7 // 8, at + 1):
            found = [m.start() for m in _PARTED.finditer(text, begin, at + size)]
            if found:
                end = found[-1]
                break
        yield text[at:end]
        at = end
    yield text[at:]


def count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of text; 0 of null or empty text."""
    if not text:
        return 0
    enc = encoder(path)
    if len(text) <= BLOCK:
        return len(enc.encode_ordinary(text))
    return sum(len(enc.encode_ordinary(b)) for b in blocks(text))


def ends(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Character offset at which each token ends; a token that ends inside a character ends before it."""
    enc, sizes = encoder(path), []
    for b in blocks(text):
        ids = enc.encode_ordinary(b)
        sizes.append(np.fromiter((len(x) for x in enc.decode_tokens_bytes(ids)), dtype=np.int64, count=len(ids)))
    at_byte = np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    inside = np.concatenate([(raw & 0xC0) == 0x80, [False]])
    return starts[at_byte] - inside[at_byte]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Column of token counts (BIGINT), 0 for null."""

    @F.pandas_udf("bigint")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([count(x, path) for x in s], dtype="int64")

    return tokens(text)
