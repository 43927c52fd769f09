"""Composite analyses: which material goes into a model's prompt, and what comes back into the store.

Each function gives the plan of the material; ``prompts`` puts the pieces of one task together, and a connector asks
the model. Which meetings are read in full is decided over (id, length) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..connectors import Model
from ..functions import text as T
from ..operators import budget, entities, glossary, library, markdown, ranking
from ..schemas import TEMPLATES, TRACK_MODES, TYPES

#: Characters of meetings, memory and glossary that go into one prompt, and of one meeting.
CROSS, MEMORY, GLOSSARY, PER_MEETING = 160_000, 6_000, 3_000, 60_000


def chosen(meetings: DataFrame, query: str, limit: int = CROSS, boost: DataFrame | None = None) -> DataFrame:
    """meetings (with content) and ``full``: whether each is read in full. All are if they fit.

    Otherwise they are taken greedily, by relevance to the query or newest first without one.
    """
    m = meetings.withColumn("n_chars", F.length("content"))
    total = m.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("t")).first().t
    if total <= limit:
        return m.withColumn("full", F.lit(True))
    scored = ranking.relevance(m, query, boost) if query.strip() else m.withColumn("score", F.lit(0))
    # ranks by descending date need a value that sorts the other way round
    rank = F.struct((-F.col("score")).alias("s"), (-F.unix_micros(F.to_timestamp("created"))).alias("c"), F.col("meeting_id").alias("m"))
    slim = scored.select(F.lit(1).alias("g"), "meeting_id", "n_chars", rank.alias("rank"))
    taken = budget.greedy(slim, ["g"], "rank", "n_chars", limit).select("meeting_id", F.lit(True).alias("full"))
    return m.join(taken, "meeting_id", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def context(meetings: DataFrame, limit: int = CROSS, per_meeting: int | None = PER_MEETING) -> DataFrame:
    """(meeting_id, date, participants, content) in order of time, cut to what fits."""
    who = T.squeeze(F.replace(F.coalesce("participants", F.lit("")), F.lit('"'), F.lit("'")))
    m = meetings.select(F.lit(1).alias("g"), "meeting_id", "date", "created", who.alias("participants"), "content")
    return budget.concatenated(m, ["g"], ["date", "created", "meeting_id"], "content", limit, per_meeting).drop("g", "created")


def index_lines(meetings: DataFrame) -> DataFrame:
    """One line for each meeting that isn't read in full."""
    d = F.coalesce("digest", F.lit(""))
    return meetings.select("meeting_id", F.concat(F.lit("- ["), "meeting_id", F.lit("] "), "date", F.lit(" "), "title", F.when(d != "", F.concat(F.lit(": "), d)).otherwise("")).alias("line"))


def memory_lines(e: DataFrame, text: str, limit: int = MEMORY, facts: int = 2, lang: str = "en") -> DataFrame:
    """(kind_no, n, line) of the entries a text talks about, within the budget.

    A type ends at its first line that doesn't fit; later types may still use what is left. At most 40 entries come
    out of the look-up, so the fold over them is small.
    """
    few = entities.relevant(e, text)
    fact = F.array_join(F.transform(F.filter(T.tail(F.col("facts"), facts), lambda f: F.coalesce(f["text"], F.lit("")) != ""), lambda f: F.concat(F.when(F.coalesce(f["date"], F.lit("")) != "", F.concat(f["date"], F.lit(" "))).otherwise(""), F.substring(f["text"], 1, 120))), "；")
    src = F.try_element_at("sources", F.lit(-1))
    line = F.concat(markdown.entry_line(lang), F.when(fact != "", F.concat(F.lit(" "), fact)).otherwise(""), F.when(src.isNotNull(), F.concat(F.lit(" ["), src, F.lit("]"))).otherwise(""))
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")).cast("int")
    rows = few.select(kind.alias("kind_no"), F.col("score"), "updated", "ord", line.alias("line"))
    listed = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("kind_no", (-F.col("score")).alias("s"), "updated", "ord", "line"))).alias("all"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("closed"), F.expr("cast(array() as array<struct<kind_no:int,line:string>>)").alias("out"))
    fold = F.aggregate(
        "all",
        zero,
        lambda acc, x: F.when((acc["closed"] == x["kind_no"]) | (acc["used"] >= limit), acc)
        .when(acc["used"] + F.length(x["line"]) > limit, F.struct(acc["used"].alias("used"), x["kind_no"].alias("closed"), acc["out"].alias("out")))
        .otherwise(F.struct((acc["used"] + F.length(x["line"])).alias("used"), acc["closed"].alias("closed"), F.array_append(acc["out"], F.struct(x["kind_no"].alias("kind_no"), x["line"].alias("line"))).alias("out"))),
    )
    return listed.select(F.posexplode(fold["out"]).alias("n", "x")).select("x.kind_no", "n", "x.line")


def glossary_lines(g: DataFrame, text: str, limit: int = GLOSSARY) -> DataFrame:
    """(rank, ord, line): entries whose spelling occurs in the text, then the other names, as long as they fit."""
    low = F.lit(text.lower())
    hit = F.exists(F.concat(F.array("term"), "wrong"), lambda v: (v != "") & F.contains(low, F.lower(v)))
    line = F.concat(F.lit("- "), "term", F.when(F.size("wrong") > 0, F.concat(F.lit("（"), F.array_join("wrong", "、"), F.lit("）"))).otherwise(""), F.when(F.col("note") != "", F.concat(F.lit("｜"), F.substring("note", 1, 60))).otherwise(""))
    sec = F.when(F.col("section") == "names", 0).otherwise(1)
    rows = g.select(F.when(hit, 0).when(F.col("section") == "names", 1).alias("rank"), (sec * 100_000 + F.col("ord")).alias("ord"), F.when(hit, line).otherwise(F.concat(F.lit("- "), "term")).alias("line")).where("rank is not null")
    return budget.prefix(rows.withColumn("g", F.lit(1)).withColumn("n", F.length("line")), ["g"], ["rank", "ord"], "n", limit, gap=1).select("rank", "ord", "line")


def open_commitments(e: DataFrame, last: int = 60) -> DataFrame:
    """The last commitments still open or unknown, in the store's order."""
    return e.where("type = 'commitment' and status in ('open', 'unknown')").orderBy(F.desc("ord")).limit(last)


def people_line(participants: str) -> str:
    who = " ".join(participants.split())
    return f"<participants>\n{who}\n</participants>\n\n" if who else ""


def joined(df: DataFrame, order: list[str], text: str, sep: str = "\n") -> str:
    """Lines of a result whose size a budget bounds, as one text for a prompt."""
    return sep.join(r[0] for r in df.orderBy(*order).select(text).collect())


class Analyses:
    """Questions to a library: every method gives the prompt it asks the model with, and the answer."""

    def __init__(self, spark: SparkSession, meetings: DataFrame, store: DataFrame, terms: DataFrame, model: Model) -> None:
        """meetings: summaries with content (the transcript); store: entities; terms: the glossary."""
        self.spark, self.meetings, self.store, self.terms, self.model = spark, meetings.where(F.length("content") > 0), store, terms, model

    def _prompt(self, task: str, question: str, meetings: DataFrame, limit: int = CROSS, memory: int = MEMORY, per_meeting: int | None = PER_MEETING, extra: str = "") -> str:
        picked = chosen(meetings, question, limit, entities.source_boost(entities.relevant(self.store, question, 12)))
        ctx = joined(
            context(picked.where("full"), limit, per_meeting).withColumn("block", F.concat(F.lit('<meeting id="'), "meeting_id", F.lit('" date="'), "date", F.lit('">\n'), "content", F.lit("\n</meeting>"))),
            ["date", "meeting_id"], "block", "\n\n",
        )
        rest = joined(index_lines(picked.where("not full")), ["meeting_id"], "line")
        material = f"{question}\n{ctx[:60_000]}"
        parts = [
            ("glossary", joined(glossary_lines(self.terms, material), ["rank", "ord"], "line")),
            ("memory", joined(memory_lines(self.store, material, memory), ["n"], "line")),
            ("task", f"{task}\n{question}".strip()),
            ("extra", extra),
            ("library_index", rest),
            ("meetings", ctx),
        ]
        return "\n\n".join(f"<{k}>\n{v}\n</{k}>" for k, v in parts if v)

    def ask(self, question: str) -> tuple[str, str]:
        p = self._prompt("ask", question, self.meetings)
        return p, self.model(p, "ask")

    def report(self, meeting_id: str, template: str = "minutes") -> tuple[str, str]:
        if template not in TEMPLATES:
            raise ValueError(f"unknown template {template}")
        p = self._prompt(f"report {template} {TEMPLATES[template]}", "", self.meetings.where(F.col("meeting_id") == meeting_id))
        return p, self.model(p, "report")

    def track(self, focus: str = "", mode: str = "track", ids: list[str] | None = None) -> tuple[str, str]:
        if mode not in TRACK_MODES:
            raise ValueError(f"unknown mode {mode}")
        m = self.meetings if ids is None else self.meetings.where(F.col("meeting_id").isin(*ids)).dropDuplicates(["meeting_id"])
        if m.limit(2).count() < 2:
            raise ValueError("two meetings at least are needed")
        owed = ""
        if mode == "track":
            src = F.coalesce(F.try_element_at("sources", F.lit(-1)), F.lit(""))
            owed = joined(open_commitments(self.store).withColumn("line", F.concat(F.lit("- "), "name", F.lit("："), F.substring("summary", 1, 160), F.lit(" ["), src, F.lit("]"))), ["ord"], "line")
        p = self._prompt(f"track {mode}", focus, m, memory=4000, extra=owed)
        return p, self.model(p, "track")

    def prep(self, topic: str, people: str = "", goal: str = "") -> tuple[str, str]:
        if not topic.strip():
            raise ValueError("a topic is needed")
        ids = ranking.related(self.meetings, people, topic).select("meeting_id")
        p = self._prompt("prep", "\n".join(filter(None, (topic, people, goal))), self.meetings.join(ids, "meeting_id", "leftsemi"), memory=8000)
        return p, self.model(p, "prep")

    def daily(self, date: str) -> tuple[str, str]:
        m = library.between(self.meetings, date, date)
        if m.isEmpty():
            raise ValueError(f"no meetings on {date}")
        p = self._prompt(f"brief {date}", "", m, memory=3000, per_meeting=None)
        return p, self.model(p, "brief")

    def weekly(self, monday: str, sunday: str, label: str) -> tuple[str, str]:
        m = library.between(self.meetings, monday, sunday)
        if m.isEmpty():
            raise ValueError(f"no meetings in {label}")
        p = self._prompt(f"weekly {label} {monday} {sunday}", "", m, memory=4000)
        return p, self.model(p, "weekly")

    def memorise(self, meeting_id: str, stamp: str, least_chars: int = 200) -> DataFrame:
        """The store after the model has read one meeting; unchanged if there is too little to read or no answer."""
        row = self.meetings.where((F.col("meeting_id") == meeting_id) & (F.length("content") >= least_chars)).select("content", "date").first()
        if row is None:
            return self.store
        known = entities.relevant(self.store, row.content)
        cands = joined(entities.candidates(known), ["ord"], "json", ",\n")
        index = joined(entities.name_index(self.store).withColumn("line", F.concat("type", F.lit(": "), "names")), ["type"], "line")
        p = f"<candidates>\n[{cands}]\n</candidates>\n\n<names>\n{index}\n</names>\n\n<meeting id=\"{meeting_id}\" date=\"{row.date}\">\n{row.content}\n</meeting>"
        return apply_output(self.store, self.spark.createDataFrame([(meeting_id, row.date, self.model(p, "merge"))], "source string, date string, answer string"), stamp)

    def tidy(self, stamp: str, batch: int = 8) -> DataFrame:
        """The store with overlong entries shortened by the model, batch by batch, where the answer passes the guard.

        The model is asked from the partitions, so it must be able to go there; an answer that cannot be read, or
        names an entry of another batch, changes nothing.
        """
        model, fact = self.model, lambda f: (f.get("text"), f.get("date") or "", f.get("source") or "")

        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json

            for rows in (p.iloc[k : k + batch] for p in parts for k in range(0, len(p), batch)):
                asked = dict(zip(rows.id, rows.asked, strict=True))
                try:
                    told = json.loads(model(f"[{', '.join(asked.values())}]", "tidy")).get("entities") or []
                except (ValueError, AttributeError):
                    told = []
                fixed = [(e["id"], e.get("summary"), [fact(f) for f in e.get("facts") or []]) for e in told if e.get("id") in asked]
                yield pd.DataFrame(fixed, columns=["id", "summary", "facts"])

        todo = entities.tidy_targets(self.store).select("id", F.to_json(F.struct("id", "name", "summary", "facts")).alias("asked"))
        answers = runtime.stored(todo.mapInPandas(ask, "id string, summary string, facts array<struct<text:string,date:string,source:string>>"), "tidied")
        changes = answers.join(self.store.select("id", F.col("facts").alias("was")), "id").where(entities.tidied(F.col("was"), F.col("facts"))).drop("was")
        return entities.updated(self.store, changes.withColumn("summary", F.nullif("summary", F.lit(""))).dropDuplicates(["id"]), stamp)


MODEL_ITEM = "array<struct<type:string,name:string,aliases:array<string>,summary:string,facts:array<struct<text:string,date:string,source:string>>,status:string,owner:string,due:string>>"


def apply_output(store: DataFrame, answers: DataFrame, stamp: str) -> DataFrame:
    """The store after models' answers (source, date, answer): {"entities": [...]}, fenced or with words around it."""
    items = F.from_json(F.get_json_object(T.json_object(F.col("answer")), "$.entities"), MODEL_ITEM)
    rows = answers.select("source", "date", F.posexplode(items).alias("k", "i"))
    fact = lambda f: F.struct(f["text"].alias("text"), F.coalesce(F.nullif(f["date"], F.lit("")), F.col("date")).alias("date"), F.coalesce(F.nullif(f["source"], F.lit("")), F.col("source")).alias("source"))
    facts = F.transform(F.coalesce("i.facts", F.expr("cast(array() as array<struct<text:string,date:string,source:string>>)")), fact)
    n = F.monotonically_increasing_id()
    batch = rows.orderBy("date", "source", "k").select("i.type", "i.name", F.coalesce("i.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("i.summary", F.lit("")).alias("summary"), facts.alias("facts"), *[F.coalesce(f"i.{x}", F.lit("")).alias(x) for x in ("status", "owner", "due")], n.alias("n"))
    return entities.upserted(store, runtime.cut(batch), stamp)


__all__ = ["Analyses", "apply_output", "chosen", "context", "glossary", "glossary_lines", "index_lines", "memory_lines", "open_commitments", "people_line"]
