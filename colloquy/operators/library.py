"""The library of meetings: projection, filters, look-up, search, and joins with stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime
from ..functions import text as T


def effective_date(date: Column, created: Column, meeting_id: Column) -> Column:
    """The date set by hand, else of creation, else in the id, else ''."""
    day = F.date_format(created, "yyyy-MM-dd")
    return F.coalesce(F.nullif(date, F.lit("")), day, F.regexp_extract(meeting_id, r"^\d{4}-\d{2}-\d{2}", 0))


def summaries(meetings: DataFrame) -> DataFrame:
    """One row per meeting with its effective date and every absent value as its default."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return meetings.distinct().select(
        "meeting_id",
        F.coalesce(F.nullif("title", F.lit("")), F.col("meeting_id")).alias("title"),
        "created",
        effective_date(F.col("meeting_date"), F.col("created"), F.col("meeting_id")).alias("date"),
        text("source"),
        F.coalesce("status", F.lit("new")).alias("status"),
        *map(text, ("duration", "lang", "participants", "digest", "channel")),
        F.coalesce("gaps", F.lit(0)).alias("gaps"),
        F.coalesce("glossary_fixed", F.lit(0)).alias("glossary_fixed"),
        F.coalesce("error_text", F.lit("")).alias("error"),
    )


NEWEST = (F.desc, ("date", "created", "meeting_id"))


def newest(s: DataFrame) -> DataFrame:
    return s.orderBy(*[F.desc(c) for c in NEWEST[1]])


def between(s: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Meetings of a span of days, both ends included and each optional."""
    if first:
        s = s.where(F.col("date") >= first)
    return s.where(F.col("date") <= last) if last else s


def unique_hits(keys: DataFrame, meetings: DataFrame) -> DataFrame:
    """(key, meeting_id) of keys that name one meeting: by its id, else as part of one id or title only.

    The keys are what a user asks for, a handful: they go to the meetings as a checked broadcast.
    """
    k = runtime.small(keys.select("key").distinct())
    m = meetings.select("meeting_id", "title")
    found = m.join(k, F.contains("meeting_id", "key") | F.contains("title", "key"))
    g = found.groupBy("key").agg(F.count("*").alias("n"), F.min("meeting_id").alias("one"), F.max(F.when(F.col("meeting_id") == F.col("key"), F.col("meeting_id"))).alias("exact"))
    return g.where("exact is not null or n = 1").select("key", F.coalesce("exact", "one").alias("meeting_id"))


def doc_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, line_no, line) of texts in column content, line numbers from 1."""
    return docs.select(*keep, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def search(files: DataFrame, meetings: DataFrame, query: str, per_meeting: int = 4, limit: int = 50, transcript: str = "transcript") -> DataFrame:
    """Lines that hold the query, whatever their case: at most so many of a meeting, of the newest meetings.

    files has meeting_id, label (``transcript`` before reports, these by name) and content. Headings are passed over,
    and in transcripts header lines too. The meetings' dates are joined after the lines are few.
    """
    q = query.strip().lower()
    if not q:
        return files.select("meeting_id", F.lit("").alias("title"), "label", F.lit(0).alias("line_no"), F.lit("").alias("line")).where(F.lit(False))
    hits = doc_lines(files.where(F.contains(F.lower("content"), F.lit(q))), "meeting_id", "label").where(
        ~F.col("line").startswith("#") & ~((F.col("label") == transcript) & F.col("line").startswith("- ")) & F.contains(F.lower("line"), F.lit(q))
    )
    order = Window.partitionBy("meeting_id").orderBy(F.col("label") != transcript, "label", "line_no")
    few = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_meeting).select("meeting_id", "label", "line_no", F.substring(T.strip(F.col("line")), 1, 120).alias("line"))
    chosen = newest(meetings.join(few.select("meeting_id").distinct(), "meeting_id", "leftsemi").select("meeting_id", "title", "date", "created")).limit(limit)
    return few.join(F.broadcast(chosen), "meeting_id").select("meeting_id", "title", "label", "line_no", "line")  # at most ``limit`` rows


def doc_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first line of each stored document that holds the query; kinds in their order, newest name first."""
    q = query.strip().lower()
    kinds = F.array_position(F.array(*[F.lit(k) for k in ("brief", "weekly", "tracking", "prep")]), F.col("kind"))
    at = doc_lines(docs.where(F.contains(F.lower("content"), F.lit(q))), "kind", "name").where(F.contains(F.lower("line"), F.lit(q)))
    first = at.groupBy("kind", "name").agg(F.min_by("line", "line_no").alias("line"))
    return first.where(kinds > 0).orderBy(kinds, F.desc("name")).limit(limit).select("kind", "name", F.substring(T.strip(F.col("line")), 1, 140).alias("line"))


def titles_not_hit(meetings: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Meetings whose title or digest holds the query and whose files don't."""
    q = F.lit(query.strip().lower())
    m = meetings.where(F.contains(F.lower("title"), q) | F.contains(F.lower("digest"), q))
    return m.join(hits.select("meeting_id").distinct(), "meeting_id", "leftanti").select(
        "meeting_id", "title", F.coalesce(F.nullif(F.substring("digest", 1, 120), F.lit("")), F.col("title")).alias("line")
    )


def found_everywhere(hits: DataFrame, titles: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """One table of (section, id, title, line): meetings by text and by title, entries, documents."""
    lit = F.lit
    return (
        hits.select(lit("text").alias("section"), F.col("meeting_id").alias("id"), "title", "line")
        .unionByName(titles.select(lit("title").alias("section"), F.col("meeting_id").alias("id"), "title", "line"))
        .unionByName(entities.select(lit("memory").alias("section"), "id", F.col("name").alias("title"), F.col("snippet").alias("line")))
        .unionByName(docs.select(F.col("kind").alias("section"), F.col("name").alias("id"), F.col("name").alias("title"), "line"))
    )


def periods(present: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Periods the library has or a document is stored for, content null where none is."""
    return present.select(key).distinct().join(stored.select(key, "content"), key, "full")


def unprocessed(items: DataFrame, done: DataFrame, key: str, least_chars: int = 0) -> DataFrame:
    """Items not in the ledger, and long enough."""
    long = items.where(F.length("content") >= least_chars) if least_chars else items
    return long.join(done.select(key), key, "leftanti")


def overlay(meta: DataFrame, changes: DataFrame, key: str = "meeting_id") -> DataFrame:
    """meta with the values of changes that are not null; new keys are added."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    j = meta.join(c, key, "full")
    return j.select(key, *[F.coalesce(f"__{x}", x).alias(x) if x in fields else x for x in meta.columns if x != key])


def deleted(meetings: DataFrame, ids: DataFrame, stamp: str) -> DataFrame:
    """Meetings with a tombstone for the given ids; one that is being transcribed stays."""
    d = ids.select("meeting_id").distinct().withColumn("__d", F.lit(True))
    gone = F.col("__d").isNotNull() & (F.coalesce("status", F.lit("")) != "transcribing")
    return meetings.join(d, "meeting_id", "left").withColumn("deleted_at", F.when(gone, F.lit(stamp))).drop("__d")


def numbered_names(names: DataFrame, key: str, name: str) -> DataFrame:
    """Names made unique: the first of equal ones stays, the next gets '-2' and so on (before its ending).

    A suffixed name already taken by an original is passed over, as many times as needed.
    """
    order = Window.partitionBy(name).orderBy(key)
    n = names.withColumn("__n", F.row_number().over(order))
    stem, ext = F.regexp_replace(name, r"\.[^./]*$", ""), F.regexp_extract(name, r"(\.[^./]*)$", 1)
    taken = names.select(F.col(name).alias("__t")).distinct()
    more = n.where("__n > 1").withColumn("__s", stem).withColumn("__e", ext)
    # numbers of the same stem that originals hold
    held = taken.select(F.regexp_replace("__t", r"(-\d+)?(\.[^./]*)?$", "").alias("__s"), F.regexp_extract("__t", r"(\.[^./]*)$", 1).alias("__e"), F.regexp_extract("__t", r"-(\d+)(\.[^./]*)?$", 1).try_cast("int").alias("k"))
    held = held.where("k > 1").groupBy("__s", "__e").agg(F.array_sort(F.collect_set("k")).alias("held"))
    number = F.aggregate(F.coalesce("held", F.array().cast("array<int>")), F.col("__n"), lambda acc, k: F.when(k <= acc, acc + 1).otherwise(acc))
    again = more.join(held, ["__s", "__e"], "left").withColumn("unique_name", F.concat("__s", F.lit("-"), number.cast("string"), "__e"))
    return n.where("__n = 1").select(key, name, F.col(name).alias("unique_name")).unionByName(again.select(key, name, "unique_name"))


def run_stats(meetings: DataFrame, transcripts: DataFrame, reports: DataFrame) -> DataFrame:
    """How many meetings, transcripts, reports and failed meetings there are, in one row."""
    kinds = {"meetings": meetings, "transcripts": transcripts, "reports": reports, "errors": meetings.where("error != ''")}
    rows = None
    for name, df in kinds.items():
        tagged = df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds])


def with_transcript(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Meetings that have a transcript with text."""
    return meetings.join(transcripts.where(F.length("md_text") > 0).select("meeting_id"), "meeting_id", "leftsemi")


def dashboard(meetings: DataFrame, entities: DataFrame, glossary: DataFrame, most: int = 400) -> DataFrame:
    """One row: meetings (with a transcript), entries by type, open commitments, glossary entries, and people's names.

    Of the names the first ``most`` of the store come, as on a screen.
    """
    of = lambda t: F.count_if(F.col("type") == t)
    e = entities.agg(of("person").alias("persons"), of("project").alias("projects"), of("commitment").alias("promises"), F.count_if((F.col("type") == "commitment") & (F.col("status") == "open")).alias("open"), of("term").alias("terms"))
    people = entities.where("type = 'person'").select("ord", "name").orderBy("ord").limit(most).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("person_names"))
    # counts of one row each, side by side by a common key
    rows = [meetings.agg(F.count("*").alias("meetings")), e, glossary.agg(F.count("*").alias("glossary")), people]
    one, *rest = [r.withColumn("g", F.lit(1)) for r in rows]
    for r in rest:
        one = one.join(F.broadcast(r), "g")
    return one.drop("g")


#: Kinds of documents of which a new one replaces that of the same name.
REPLACED = ("brief", "weekly")


def filed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The documents (kind, name, content) after new ones come in.

    Of briefs and weekly reports a new one takes the place of that of its name; any other gets a name of its own, with
    '-2' and so on behind it.
    """
    both = existing.select("kind", "name", "content", F.lit(0).alias("late")).unionByName(new.select("kind", "name", "content", F.lit(1).alias("late")))
    replaced = F.col("kind").isin(*REPLACED)
    kept = both.where(replaced).groupBy("kind", "name").agg(F.max_by("content", F.struct("late", "content")).alias("content"))
    others = both.where(~replaced).withColumn("__path", F.concat_ws("/", "kind", "name")).withColumn("__key", F.concat_ws("\u0001", "late", F.xxhash64("content"), "__path"))
    names = numbered_names(others.select("__key", "__path").distinct(), "__key", "__path")
    renamed = others.drop("__path").dropDuplicates(["__key"]).join(names, "__key").select("kind", F.regexp_replace("unique_name", "^[^/]*/", "").alias("name"), "content")
    return kept.unionByName(renamed)


def edited(meetings: DataFrame, changes: DataFrame) -> DataFrame:
    """Meetings with a new title, date or participants (null leaves one): blank titles and dates that are none change nothing."""
    c = changes.select(
        "meeting_id",
        F.nullif(T.squeeze(F.col("title")), F.lit("")).alias("title"),
        F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull(), F.col("date")).alias("date"),
        T.squeeze(F.col("participants")).alias("participants"),
    )
    return overlay(meetings, c.join(meetings.select("meeting_id"), "meeting_id", "leftsemi"))


def recent(meetings: DataFrame, n: int = 10) -> DataFrame:
    """The latest meetings, as many as a screen lists."""
    return newest(meetings).limit(n)
