"""Which meetings a question is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def relevance(meetings: DataFrame, query: str, boost: DataFrame | None = None) -> DataFrame:
    """meetings (meeting_id, title, digest, content, date, created) with their score.

    Each keyword counts five for every place in title and digest and one for every place in the text, twenty at
    most; a keyword given twice counts twice. ``boost`` (meeting_id, boost) is added.
    """
    keys = F.transform(T.keywords(F.lit(query)), F.lower)
    head = F.lower(F.concat("title", F.lit(" "), F.coalesce("digest", F.lit(""))))
    body = F.lower(F.coalesce("content", F.lit("")))
    one = lambda k: T.count_of(head, k) * 5 + F.least(T.count_of(body, k), F.lit(20))
    m = meetings.withColumn("score", F.aggregate(keys, F.lit(0), lambda acc, k: acc + one(k)))
    if boost is not None:
        m = m.join(boost, "meeting_id", "left").withColumn("score", (F.col("score") + F.coalesce("boost", F.lit(0))).cast("int")).drop("boost")
    return m


def ranked(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.desc("date"), F.desc("created"), F.desc("meeting_id"))


def related(meetings: DataFrame, people: str, topic: str, top: int = 6, recent: int = 3) -> DataFrame:
    """The best meetings that hold any of the words; where none does, the latest. ``how`` tells which."""
    words = " ".join(w for w in (people, topic) if w)
    keys = T.keywords(F.array_join(F.concat(T.words(F.lit(people)), T.words(F.lit(topic))), " "))
    text = F.lower(F.concat("title", F.coalesce("content", F.lit("")), F.coalesce("digest", F.lit(""))))
    best = ranked(relevance(meetings, words)).limit(top)
    hits = best.where(F.exists(F.transform(keys, F.lower), lambda k: F.contains(text, k))).select("meeting_id", "score", F.lit("relevance").alias("how"))
    latest = meetings.orderBy(F.desc("date"), F.desc("created"), F.desc("meeting_id")).limit(recent).select("meeting_id", F.lit(0).alias("score"), F.lit("recent").alias("how"))
    any_hit = hits.select(F.lit(1).alias("g")).distinct()
    return hits.unionByName(latest.withColumn("g", F.lit(1)).join(any_hit, "g", "leftanti").drop("g"))
