"""The glossary: parsing, prompt terms, hits in material, and corrections that need no context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as T
from ..schemas import LOCALES
from . import matching
from .markdown import canonical

#: Labels of misheard forms in a glossary line.
MISHEARD = sorted({"误写", "misheard", "mis-heard", "variants", "variant", "aka", "erreurs", "variantes", "erreur", *(x["sections"]["misheard"] for x in LOCALES.values())}, key=len, reverse=True)
_WRONG = rf"(?i)[（(]\s*(?:{'|'.join(MISHEARD)})\s*[:：]\s*([^）)]*)[）)]"


def section_of(heading: Column) -> Column:
    """names or terms: by the heading itself in any language, else by the words in it."""
    c, h = canonical(heading), F.lower(heading)
    loose = F.lit(False)
    for w in ("人名", "name", "nom", "person", "people"):
        loose = loose | F.contains(h, F.lit(w))
    return F.when(c == "names", "names").when(c == "glossary_terms", "terms").when(loose, "names").otherwise("terms")


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, section, ord, term, wrong, note) of glossary texts (doc_id, content).

    Comments, rules and sentences of more than 40 characters are no entries; an unknown heading is of terms.
    """
    text = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    lines = docs.select("doc_id", F.posexplode(F.split(text, r"\R")).alias("line_no", "raw")).withColumn("line", T.strip(F.col("raw")))
    head = T.strip(F.regexp_replace("line", "^#+", ""))
    titled = F.coalesce(canonical(head).isin("glossary_title", "longterm_title", "memory_title"), F.lit(False))
    own = F.when(F.col("line").startswith("#") & (head != "") & ~titled, section_of(head))
    w = Window.partitionBy("doc_id").orderBy("line_no")  # a glossary is one file that people read
    s = lines.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit("terms"))).where(F.col("line").rlike("^[-*] "))
    body = F.replace(T.strip(F.substring("line", 3, 100_000)), F.lit("**"), F.lit(""))
    b = s.withColumn("body", body).withColumn("w", F.regexp_extract("body", _WRONG, 1)).withColumn("rest", F.regexp_replace("body", _WRONG, ""))
    parts = F.split("rest", "[｜|]", 2)
    b = b.withColumn("t", T.strip(F.get(parts, F.lit(0)))).withColumn("n", T.strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    plain = r"^(.+?)[（(]([^）)]*)[）)]\s*$"
    noted = F.col("t").rlike(plain)
    b = b.withColumn("note", F.when(noted, T.strip(F.concat_ws(" ", T.strip(F.regexp_extract("t", plain, 2)), F.nullif("n", F.lit(""))))).otherwise(F.col("n")))
    b = b.withColumn("term", F.regexp_replace(F.when(noted, F.regexp_extract("t", plain, 1)).otherwise(F.col("t")), "^[ \\-—·*＝=~～]+|[ \\-—·*＝=~～]+$", ""))
    wrong = F.filter(F.transform(F.split("w", "[、,，/；;]"), T.strip), lambda x: x != "")
    return b.where((F.col("term") != "") & (F.length("term") <= 40)).select("doc_id", "section", F.col("line_no").alias("ord"), "term", wrong.alias("wrong"), "note")


def counts(g: DataFrame) -> DataFrame:
    return g.groupBy("section").agg(F.count("*").alias("n"))


def prompt_terms(g: DataFrame, limit: int = 15) -> DataFrame:
    """The distinct terms a speech engine is told: those with misheard forms first (terms, then names), then the rest (names, then terms)."""
    wronged = F.size("wrong") > 0
    rank = F.when(wronged, F.when(F.col("section") == "terms", 0).otherwise(1)).otherwise(F.when(F.col("section") == "names", 2).otherwise(3))
    first = g.groupBy("term").agg(F.min(F.struct(rank.alias("rank"), F.col("ord").alias("ord"))).alias("r"))
    return first.orderBy("r.rank", "r.ord").limit(limit).select("term", F.col("r.rank").alias("rank"), F.col("r.ord").alias("ord"))


def capped_terms(g: DataFrame, most: int = 200) -> DataFrame:
    """Terms, names first, as long as they and the marks between them fit."""
    w = Window.orderBy(F.col("section") != "names", "ord").rowsBetween(Window.unboundedPreceding, 0)  # one short file
    used = F.sum(F.length("term") + 1).over(w)
    over = F.sum(F.when(F.col("used") > most, 1).otherwise(0)).over(w)
    return g.withColumn("used", used).withColumn("over", over).where("over = 0").select("section", "ord", "term", "used")


def prompt_cut(terms: Column, most: int = 160) -> Column:
    """A list of terms cut to so many characters at its last mark."""
    return F.when(F.length(terms) > most, F.regexp_replace(F.substring(terms, 1, most), "、[^、]*$", "")).otherwise(terms)


def hits(g: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, section, ord, term): entries whose term or misheard form occurs in a text, whatever the case."""
    v = g.select("section", "ord", "term", F.explode(F.transform(F.concat(F.array("term"), "wrong"), F.lower)).alias("k")).where("k != ''").distinct()
    found = matching.occurrences(texts.select("doc_id", F.lower("content").alias("low")), v.select("k", F.lit(False).alias("whole")))
    return found.join(runtime.small(v), "k").select("doc_id", "section", "ord", "term").distinct()


def safe_replacements(g: DataFrame) -> DataFrame:
    """(wrong, right): misheard names of three Chinese characters or more that may be put right without context.

    Forms that contain the term or lie in it are left; of equal forms the first entry's counts; longest first.
    """
    w = g.where("section = 'names'").select("ord", "term", F.posexplode("wrong").alias("k", "w")).withColumn("w", T.strip(F.col("w")))
    ok = (F.col("w") != "") & ~F.contains("w", "term") & ~F.contains("term", "w") & (F.regexp_count("w", F.lit(T.CJK)) >= 3) & ~F.col("w").rlike("[A-Za-z]")
    first = w.where(ok).groupBy(F.col("w").alias("wrong")).agg(F.min_by("term", F.struct("ord", "k")).alias("right"), F.min(F.struct("ord", "k")).alias("at"))
    return first.orderBy(F.desc(F.length("wrong")), "at").select("wrong", "right")


def corrected(texts: DataFrame, replacements: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, content, n) after the replacements, one after the other; n counts them."""
    text, n = F.col("content"), F.lit(0)
    for wrong, right in replacements:
        n = n + T.count_of(text, F.lit(wrong))
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return texts.select("doc_id", text.alias("content"), n.alias("n"))


def rewrite_allowed(old: Column, new: Column) -> Column:
    """Whether a rewritten glossary may replace the old one: both parts are there, and not under six tenths of a long one."""
    heads = F.transform(F.regexp_extract_all(new, F.lit(r"(?m)^## .*$"), F.lit(0)), canonical)
    both = F.array_contains(heads, "names") & F.array_contains(heads, "glossary_terms")
    return F.coalesce(both, F.lit(False)) & ~((F.length(old) > 1000) & (F.length(new) < 0.6 * F.length(old)))


def name_fix_allowed(old: Column, new: Column) -> Column:
    """Whether a text with corrected names may replace the old one: about as long, about as many lines."""
    ratio = F.length(new) / F.greatest(F.length(old), F.lit(1))
    lines = F.abs(F.regexp_count(new, F.lit("\n")) - F.regexp_count(old, F.lit("\n")))
    return (T.strip(old) != "") & (F.length(old) <= 80_000) & ratio.between(0.8, 1.2) & (lines <= 2)
