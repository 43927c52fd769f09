"""Texts in the language asked for, else in the fallback languages, else the path itself."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FALLBACK, LOCALES
from .text import locale_code


def flat(tree: dict, at: str = "") -> Iterator[tuple[str, str]]:
    for k, v in tree.items():
        path = f"{at}.{k}" if at else k
        yield from flat(v, path) if isinstance(v, dict) else [(path, v)]


def text(path: Column, lang: Column, **values: Column) -> Column:
    """The text of a path, with {name} replaced by the given values."""
    table = F.create_map(*[F.lit(x) for code, tree in LOCALES.items() for p, v in flat(tree) for x in (f"{code}/{p}", v)])
    codes = [F.coalesce(locale_code(lang), F.lit(FALLBACK[0])), *map(F.lit, FALLBACK)]
    out = F.coalesce(*[F.try_element_at(table, F.concat(c, F.lit("/"), path)) for c in codes], path)
    for k, v in values.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return out


def merged(base: dict, over: dict) -> dict:
    """A tree of texts with another laid over it; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(base.get(k) if isinstance(base.get(k), dict) else {}, v) if isinstance(v, dict) else v
    return out
