"""The engine's queries over the test tables, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .functions import text as T
from .operators import budget, entities, export, glossary, library, markdown, ranking, sequence
from .operators.ordered import Ordered
from .plans import analyses
from .runtime import table
from .sources import readers
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- the tables as the engine sees them --------------------------------------------------------------------------

ENT = r"""ent AS (SELECT entity_id AS id, entity_type AS type, name, coalesce(aliases, []) AS aliases, coalesce(summary, '') AS summary,
 coalesce(facts, []) AS facts, coalesce(sources, []) AS sources, coalesce(status, '') AS status, coalesce(owner, '') AS owner,
 coalesce(due, '') AS due, strftime(updated, '%Y-%m-%dT%H:%M:%S') AS updated, CAST(regexp_extract(entity_id, '-(\d+)$', 1) AS BIGINT) AS ord
 FROM knowledge QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY knowledge.updated DESC) = 1)"""
MEET = """m AS (SELECT meeting_id, coalesce(nullif(title, ''), meeting_id) AS title, created, coalesce(nullif(meeting_date, ''), strftime(created, '%Y-%m-%d')) AS date,
 coalesce(source, '') AS source, coalesce(status, 'new') AS status, coalesce(duration, '') AS duration, coalesce(lang, '') AS lang, coalesce(participants, '') AS participants,
 coalesce(digest, '') AS digest, coalesce(channel, '') AS channel, coalesce(gaps, 0) AS gaps, coalesce(glossary_fixed, 0) AS glossary_fixed, coalesce(error_text, '') AS error
 FROM (SELECT DISTINCT * FROM meetings))"""
SEG = """seg AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY meeting_id, seg_idx ORDER BY received_at DESC, row_id DESC) = 1)"""
DOCS = """d AS (SELECT source AS kind, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, text AS content, meeting_id FROM documents WHERE source IN ('brief', 'weekly', 'tracking', 'prep'))"""


def meetings(spark: SparkSession, d: str) -> DataFrame:
    return library.summaries(table(spark, d, "meetings"))


def store(spark: SparkSession, d: str) -> DataFrame:
    """The entries, an entry saved twice once; the number in the id is the place in the store."""
    k = ingest.latest(table(spark, d, "knowledge"), ["entity_id"], ["updated"])
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    fact = lambda f: F.struct(f["text"].alias("text"), F.coalesce(f["fact_date"], F.lit("")).alias("date"), F.coalesce(f["source"], F.lit("")).alias("source"))
    return k.select(
        F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), "name", F.coalesce("aliases", none).alias("aliases"), text("summary"),
        F.coalesce(F.transform("facts", fact), F.expr("cast(array() as array<struct<text:string,date:string,source:string>>)")).alias("facts"),
        F.coalesce("sources", none).alias("sources"), text("status"), text("owner"), text("due"), stamp("created"), stamp("updated"),
        F.regexp_extract("entity_id", r"-(\d+)$", 1).try_cast("bigint").alias("ord"),
    )


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments by their latest delivery."""
    return ingest.latest(table(spark, d, "segments"), ["meeting_id", "seg_idx"], ["received_at", "row_id"])


def docs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where(F.col("source").isin("brief", "weekly", "tracking", "prep"))
    return x.select(F.col("source").alias("kind"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("text").alias("content"), "meeting_id")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").select("section", "ord", "term", F.coalesce("wrong", F.array().cast("array<string>")).alias("wrong"), F.coalesce("note", F.lit("")).alias("note"))


def readable(spark: SparkSession, d: str) -> DataFrame:
    """Meetings with their transcript."""
    t = table(spark, d, "transcripts").where(F.length("md_text") > 0).select("meeting_id", F.col("md_text").alias("content"))
    return meetings(spark, d).join(t, "meeting_id")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- the library -------------------------------------------------------------------------------------------------

_SEARCH = f"""WITH {MEET}, f AS (SELECT meeting_id, 'transcript' AS label, md_text AS content FROM transcripts
 UNION ALL SELECT meeting_id, kind || '-' || name AS label, content FROM ({{docs}}) WHERE meeting_id IS NOT NULL),
l AS (SELECT meeting_id, label, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM f WHERE contains(lower(content), 'budget')),
h AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY label <> 'transcript', label, line_no) AS n FROM l
 WHERE NOT starts_with(line, '#') AND NOT (label = 'transcript' AND starts_with(line, '- ')) AND contains(lower(line), 'budget')),
t AS (SELECT m.meeting_id, m.title FROM m WHERE meeting_id IN (SELECT meeting_id FROM h) ORDER BY date DESC, created DESC, meeting_id DESC LIMIT 50)
SELECT h.meeting_id, t.title, label, CAST(line_no AS INT) AS line_no, left(trim(line, chr(32) || chr(9) || chr(13)), 120) AS line FROM h JOIN t USING (meeting_id) WHERE n <= 4""".replace("{docs}", "WITH " + DOCS + " SELECT * FROM d")


def _files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("meeting_id", F.lit("transcript").alias("label"), F.col("md_text").alias("content"))
    r = docs(spark, d).where("meeting_id is not null").select("meeting_id", F.concat_ws("-", "kind", "name").alias("label"), "content")
    return t.unionByName(r)


@query(_SEARCH)
def library_search(spark: SparkSession, d: str) -> DataFrame:
    return library.search(_files(spark, d), meetings(spark, d), "budget")


@query(f"""WITH {MEET} SELECT meeting_id, title, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, date, source, status, duration, lang, participants, digest, channel, gaps, glossary_fixed, error FROM m""")
def library_list(spark: SparkSession, d: str) -> DataFrame:
    return library.newest(meetings(spark, d)).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {MEET}, k AS (SELECT unnest(['client-review-1', 'budget', 'Wochenrunde', '2025-10-06-项目例会-1', 'standing']) AS key),
f AS (SELECT key, meeting_id FROM m JOIN k ON contains(meeting_id, key) OR contains(title, key))
SELECT key, coalesce(max(CASE WHEN meeting_id = key THEN meeting_id END), min(meeting_id)) AS meeting_id FROM f GROUP BY key
HAVING count(*) = 1 OR max(CASE WHEN meeting_id = key THEN 1 ELSE 0 END) = 1""")
def find_unique_key(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([(k,) for k in ("client-review-1", "budget", "Wochenrunde", "2025-10-06-项目例会-1", "standing")], "key string")
    return library.unique_hits(keys, meetings(spark, d))


@query(f"""WITH {MEET} SELECT meeting_id, date FROM m WHERE date BETWEEN '2025-06-01' AND '2025-06-30'""")
def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return library.between(meetings(spark, d), "2025-06-01", "2025-06-30").select("meeting_id", "date")


@query(f"""WITH {MEET}, w AS (SELECT DISTINCT strftime(CAST(date AS DATE), '%G-W%V') AS week, date_trunc('week', CAST(date AS DATE)) AS monday FROM m WHERE date <> ''),
k AS (SELECT strftime(created, '%G-W%V') AS week, max(text) AS content FROM documents WHERE source = 'weekly' GROUP BY 1)
SELECT coalesce(w.week, k.week) AS week, strftime(w.monday, '%Y-%m-%d') AS monday, strftime(w.monday + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday, length(k.content) AS content_chars FROM w FULL JOIN k ON w.week = k.week""")
def weekly_index(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("date")
    weeks = meetings(spark, d).where("date != ''").select(T.week_label(day).alias("week"), T.week_start(day).cast("string").alias("monday"), T.week_end(day).cast("string").alias("sunday")).distinct()
    kept = table(spark, d, "documents").where("source = 'weekly'").groupBy(T.week_label(F.to_date("created")).alias("week")).agg(F.max("text").alias("content"))
    return library.periods(weeks, kept, "week").join(weeks, "week", "left").select("week", "monday", "sunday", F.length("content").alias("content_chars"))


@query(f"""WITH {MEET}, k AS (SELECT strftime(created, '%Y-%m-%d') AS date, max(text) AS content FROM documents WHERE source = 'brief' GROUP BY 1)
SELECT coalesce(a.date, k.date) AS date, length(k.content) AS content_chars FROM (SELECT DISTINCT date FROM m) a FULL JOIN k ON a.date = k.date""")
def daily_calendar(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "documents").where("source = 'brief'").groupBy(F.date_format("created", "yyyy-MM-dd").alias("date")).agg(F.max("text").alias("content"))
    return library.periods(meetings(spark, d), kept, "date").select("date", F.length("content").alias("content_chars"))


@query(f"""WITH {MEET} SELECT i.import_id, i.meeting_id FROM (SELECT DISTINCT import_id, meeting_id, content FROM imports) i WHERE length(content) >= 200 AND meeting_id NOT IN (SELECT meeting_id FROM transcripts)""")
def anti_processed(spark: SparkSession, d: str) -> DataFrame:
    return library.unprocessed(table(spark, d, "imports").select("import_id", "meeting_id", "content").distinct(), table(spark, d, "transcripts"), "meeting_id", 200).select("import_id", "meeting_id")


@query("""WITH f AS (SELECT DISTINCT 'i' || import_id AS path, title || '.' || source_format AS name FROM imports WHERE title <> '' UNION SELECT DISTINCT 'm' || meeting_id, title || '.m4a' FROM meetings WHERE source = 'audio'),
p AS (SELECT path, regexp_replace(name, '\\.[^.]+$', '') AS stem, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS ext FROM f),
r(ext, rank) AS (VALUES ('.srt', 1), ('.vtt', 2), ('.md', 6), ('.docx', 10), ('.eml', 12)),
t AS (SELECT stem, path AS main FROM p JOIN r USING (ext) QUALIFY row_number() OVER (PARTITION BY stem ORDER BY rank, path) = 1),
a AS (SELECT stem, max(path) AS audio FROM p WHERE ext = '.m4a' GROUP BY stem)
SELECT t.stem, main, audio FROM t LEFT JOIN a USING (stem) UNION ALL SELECT a.stem, a.audio, NULL FROM a WHERE a.stem NOT IN (SELECT stem FROM t)""")
def folder_plan(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "imports").where("title != ''").select(F.concat(F.lit("i"), F.col("import_id").cast("string")).alias("path"), F.concat_ws(".", "title", "source_format").alias("name"))
    a = table(spark, d, "meetings").where("source = 'audio'").select(F.concat(F.lit("m"), "meeting_id").alias("path"), F.concat("title", F.lit(".m4a")).alias("name"))
    return readers.folder_plan(i.distinct().unionByName(a.distinct()))


_DOC_SEARCH = f"""WITH {DOCS}, l AS (SELECT kind, name, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, unnest(string_split(content, chr(10))) AS line FROM d WHERE contains(lower(content), 'roadmap')),
f AS (SELECT kind, name, arg_min(line, n) AS line FROM l WHERE contains(lower(line), 'roadmap') GROUP BY kind, name)
SELECT kind, name, left(trim(line, chr(32) || chr(9) || chr(13)), 140) AS line FROM f ORDER BY list_position(['brief', 'weekly', 'tracking', 'prep'], kind), name DESC LIMIT 20"""


@query(_DOC_SEARCH)
def doc_search(spark: SparkSession, d: str) -> DataFrame:
    return library.doc_search(docs(spark, d), "roadmap")


def _entity_search_sql(q: str) -> str:
    return f"""WITH {ENT}, w AS (SELECT *, CASE WHEN len(list_filter(list_concat([name], aliases), lambda x: contains(lower(x), '{q}'))) > 0 THEN 'name'
 WHEN contains(lower(summary), '{q}') THEN 'summary' WHEN len(list_filter(facts, lambda f: contains(lower(f.text), '{q}'))) > 0 THEN 'fact' END AS "where",
 list_filter(facts, lambda f: contains(lower(f.text), '{q}'))[1].text AS fact FROM ent),
s AS (SELECT *, CASE WHEN "where" = 'fact' THEN fact ELSE summary END AS what FROM w WHERE "where" IS NOT NULL),
i AS (SELECT *, instr(lower(what), '{q}') AS i, greatest(0, instr(lower(what), '{q}') - 31) AS a FROM s)
SELECT id, type, name, "where", CASE WHEN i = 0 OR length(what) <= 90 THEN left(what, 90) ELSE (CASE WHEN a > 0 THEN '…' ELSE '' END) || substr(what, a + 1, 90) || (CASE WHEN a + 90 < length(what) THEN '…' ELSE '' END) END AS snippet, updated
FROM i ORDER BY list_position(['name', 'summary', 'fact'], "where"), updated, ord LIMIT 30"""


_FIND = f"""WITH t AS ({_SEARCH.replace("'budget'", "'warehouse'")}), x AS ({_DOC_SEARCH.replace("'roadmap'", "'warehouse'")}), e AS ({_entity_search_sql('warehouse')}),
v AS (WITH {MEET} SELECT meeting_id, title, coalesce(nullif(left(digest, 120), ''), title) AS line FROM m WHERE contains(lower(title), 'warehouse') OR contains(lower(digest), 'warehouse'))
SELECT 'text' AS section, meeting_id AS id, title, line FROM t UNION ALL SELECT 'title', meeting_id, title, line FROM v WHERE meeting_id NOT IN (SELECT meeting_id FROM t)
UNION ALL SELECT 'memory', id, name, snippet FROM e UNION ALL SELECT kind, name, name, line FROM x"""


@query(_FIND)
def unified_find(spark: SparkSession, d: str) -> DataFrame:
    m = meetings(spark, d)
    hits = library.search(_files(spark, d), m, "warehouse")
    return library.found_everywhere(hits, library.titles_not_hit(m, hits, "warehouse"), entities.search(store(spark, d), "warehouse"), library.doc_search(docs(spark, d), "warehouse"))


@query(f"""WITH {MEET} SELECT meeting_id, title, coalesce(nullif(left(digest, 120), ''), title) AS line FROM m
WHERE (contains(lower(title), 'review') OR contains(lower(digest), 'review')) AND meeting_id NOT IN (SELECT meeting_id FROM transcripts)""")
def titles_not_hit(spark: SparkSession, d: str) -> DataFrame:
    return library.titles_not_hit(meetings(spark, d), table(spark, d, "transcripts"), "review")


@query("""SELECT meeting_id, coalesce(c.status, m.status) AS status, coalesce(c.digest, m.digest) AS digest FROM (SELECT meeting_id, any_value(status) AS status, any_value(digest) AS digest FROM meetings GROUP BY meeting_id) m
FULL JOIN (SELECT DISTINCT meeting_id, 'done' AS status, CASE WHEN length(text) > 2000 THEN 'long' END AS digest FROM transcripts) c USING (meeting_id)""")
def meta_overlay(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meetings").groupBy("meeting_id").agg(F.max("status").alias("status"), F.max("digest").alias("digest"))
    c = table(spark, d, "transcripts").select("meeting_id", F.lit("done").alias("status"), F.when(F.length("text") > 2000, "long").alias("digest"))
    return library.overlay(m, c)


@query(f"""WITH {MEET} SELECT meeting_id, CASE WHEN source = 'audio' AND status <> 'transcribing' THEN '20260101' END AS deleted_at FROM m""")
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    m = meetings(spark, d)
    return library.deleted(m, m.where("source = 'audio'").select("meeting_id"), "20260101").select("meeting_id", "deleted_at")


@query("""WITH n AS (SELECT import_id, coalesce(nullif(title, ''), 'untitled') || '.md' AS name FROM imports QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY received_at) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY import_id) AS k FROM n)
SELECT import_id, name, CASE WHEN k = 1 THEN name ELSE left(name, length(name) - 3) || '-' || k || '.md' END AS unique_name FROM r""")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    i = ingest.latest(table(spark, d, "imports"), ["import_id"], ["received_at"])
    return library.numbered_names(i.select("import_id", F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")), F.lit(".md")).alias("name")), "import_id", "name")


@query(f"""WITH {MEET} SELECT meeting_id, title, date FROM m ORDER BY date DESC, created DESC, meeting_id DESC LIMIT 10""")
def recent_meetings(spark: SparkSession, d: str) -> DataFrame:
    return library.recent(meetings(spark, d)).select("meeting_id", "title", "date")


@query("""SELECT meeting_id, status, 'event: ' || status || chr(10) || 'data: {"meeting_id":"' || meeting_id || '","title":"' || replace(coalesce(title, ''), '"', '\\"') || '"}' || chr(10) || chr(10) AS message FROM (SELECT DISTINCT meeting_id, title, status FROM meetings) WHERE status IS NOT NULL""")
def pushed_messages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "meetings").where("status is not null").select("meeting_id", F.coalesce("title", F.lit("")).alias("title"), "status").distinct()
    return m.select("meeting_id", "status", ingest.message(F.col("status"), F.struct("meeting_id", "title")).alias("message"))


@query("""SELECT import_id, CASE WHEN h LIKE 'www.%' THEN substr(h, 5) ELSE h END AS host FROM (SELECT import_id, lower(regexp_extract(content, '<[^@>\\s]+@([A-Za-z0-9.-]+)>', 1)) AS h FROM (SELECT DISTINCT import_id, content FROM imports)) WHERE h <> ''""")
def sender_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host of the first address in each import, as it would be shown for a link to it."""
    i = table(spark, d, "imports").select("import_id", "content").distinct().select("import_id", F.regexp_extract("content", r"<[^@>\s]+@([A-Za-z0-9.-]+)>", 1).alias("h")).where("h != ''")
    return i.select("import_id", T.host_label(F.concat(F.lit("https://"), "h", F.lit("/x?y=1"))).alias("host"))


# --- entries -----------------------------------------------------------------------------------------------------

_LINE = """'- **' || name || '**' || CASE WHEN len(aliases) > 0 THEN '（' || array_to_string(aliases, '、') || '）' ELSE '' END
 || CASE WHEN type = 'commitment' THEN ' · ' || CASE WHEN status = '' THEN 'unknown' ELSE status END || CASE WHEN owner <> '' THEN ' · ' || owner ELSE '' END || CASE WHEN due <> '' THEN ' · ' || due ELSE '' END ELSE '' END
 || CASE WHEN summary <> '' THEN '：' || regexp_replace(summary, '：+$', '') ELSE '' END"""
_SAYS = """CASE WHEN regexp_matches(p, '已取消|已放弃|作废|cancelled|canceled|dropped|annulé') THEN 'cancelled' WHEN regexp_matches(p, '已兑现|已完成|已生效|已部署|已定|已执行|done|fulfilled|completed|réalisé') THEN 'done'
 WHEN regexp_matches(p, '进行中|待办|待执行|待测试|待定|未兑现|推进中|in progress|open|pending|en cours') THEN 'open' ELSE 'unknown' END"""


@query(f"""WITH {ENT} SELECT count(*) FILTER (type = 'person') AS person, count(*) FILTER (type = 'project') AS project, count(*) FILTER (type = 'commitment') AS commitment,
 count(*) FILTER (type = 'term') AS term, count(*) FILTER (type = 'commitment' AND status = 'open') AS open FROM ent""")
def stats_pivot(spark: SparkSession, d: str) -> DataFrame:
    return entities.counts(store(spark, d))


@query(f"""WITH {ENT} SELECT id, type, name, status, owner, len(facts) AS n_facts, len(sources) AS n_sources, coalesce(sources[-1], '') AS last_source, updated FROM ent WHERE type = 'commitment' AND status = 'open'""")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    return entities.listed(store(spark, d), "commitment", "open").select("id", "type", "name", "status", "owner", "n_facts", "n_sources", "last_source", "updated")


@query(_entity_search_sql("budget"))
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return entities.search(store(spark, d), "budget")


@query(f"""WITH {ENT}, {MEET} SELECT f.id, CAST(f.n - 1 AS INT) AS fact_no, f.f.source AS source, coalesce(m.title, '') AS source_title FROM (SELECT id, unnest(facts) AS f, unnest(range(1, len(facts) + 1)) AS n FROM ent) f LEFT JOIN m ON m.meeting_id = f.f.source""")
def fact_titles(spark: SparkSession, d: str) -> DataFrame:
    return entities.titled_facts(store(spark, d), meetings(spark, d)).select("id", "fact_no", "source", "source_title")


@query(f"""WITH {ENT}, {MEET} SELECT e.id, e.source, coalesce(m.title, e.source) AS title, m.title IS NOT NULL AS exists_flag FROM (SELECT id, unnest(sources) AS source FROM ent) e LEFT JOIN m ON m.meeting_id = e.source""")
def source_mark_join(spark: SparkSession, d: str) -> DataFrame:
    return entities.marked_sources(store(spark, d), meetings(spark, d))


@query(f"""WITH {ENT}, s AS (SELECT id, unnest(list_concat(list_transform(facts, lambda f: f.source), sources)) AS s FROM ent)
SELECT id, string_agg(s, '|' ORDER BY s) AS all_sources FROM (SELECT DISTINCT id, s FROM s WHERE s IS NOT NULL AND s <> '') GROUP BY id""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    s = store(spark, d).select("id", entities.all_sources(F.col("facts"), F.col("sources")).alias("s"))
    return s.where(F.size("s") > 0).select("id", F.array_join("s", "|").alias("all_sources"))


_KEY = r"""lower(regexp_replace({0}, '[\s*_`''"“”‘’·・.,，。:：;；!！?？()（）\[\]【】<>《》—–\-　]+', '', 'g'))"""


@query(f"""WITH {ENT}, n AS (SELECT type, id, ord, {_KEY.format('n')} AS k FROM (SELECT type, id, ord, unnest(list_concat([name], aliases)) AS n FROM ent) WHERE n <> ''),
w AS (SELECT DISTINCT 'person' AS type, trim(x) AS name FROM (SELECT unnest(regexp_split_to_array(participants, '[,;、]')) AS x FROM meetings) WHERE trim(x) <> '')
SELECT w.name, (SELECT arg_min(id, ord) FROM n WHERE n.type = w.type AND n.k = {_KEY.format('w.name')} AND n.k <> '') AS id FROM w""")
def names_to_entries(spark: SparkSession, d: str) -> DataFrame:
    p = meetings(spark, d).select(F.explode(F.split("participants", "[,;、]")).alias("x")).select(F.lit("person").alias("type"), T.strip(F.col("x")).alias("name")).where("name != ''").distinct()
    return entities.find_by_name(store(spark, d), p).select("name", "id")


@query()
def commitment_match(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    wanted = e.where("type = 'commitment'").select(F.concat(F.lit("Please: "), "name").alias("name"))
    return entities.closest_commitment(e, wanted).withColumn("ratio", F.round("ratio", 6))


_NAMES = """n AS (SELECT id, lower(trim(n)) AS k FROM (SELECT id, unnest(list_concat([name], aliases)) AS n FROM ent) WHERE length(trim(n)) >= 2),
p AS (SELECT *, regexp_matches(k, '[a-z0-9]') AND NOT regexp_matches(k, '[㐀-鿿]') AS whole FROM n)"""
_TIMES = r"""CASE WHEN whole THEN len(regexp_extract_all(wide, '[^a-z0-9]' || regexp_escape(regexp_replace(k, '([^a-z0-9])', '\1\1', 'g')) || '[^a-z0-9]')) ELSE (length(low) - length(replace(low, k, ''))) // length(k) END"""


def _mentions_sql(texts: str) -> str:
    return rf"""WITH {ENT}, {_NAMES}, t AS (SELECT doc_id, lower(x) AS low, ' ' || regexp_replace(lower(x), '([^a-z0-9])', '\1\1', 'g') || ' ' AS wide FROM ({texts}) WHERE length(x) > 0),
c AS (SELECT doc_id, id, {_TIMES} AS n FROM t JOIN (SELECT DISTINCT * FROM p) ON contains(low, k) WHERE NOT whole OR length(k) >= 3 OR k = 'ai') SELECT doc_id, id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 HAVING sum(n) > 0"""


@query(_mentions_sql("SELECT doc_id, text AS x FROM documents"))
def mention_count(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentions(store(spark, d), texts(spark, d))


@query(_mentions_sql("SELECT meeting_id AS doc_id, md_text AS x FROM transcripts"))
def mentions_all(spark: SparkSession, d: str) -> DataFrame:
    return entities.mentions(store(spark, d), table(spark, d, "transcripts").select(F.col("meeting_id").alias("doc_id"), F.col("md_text").alias("content")))


QUESTION = "What did Dorothea Zelavodorf and Nimeshiglo Ceramics say about the backlog, the budget and the KPI?"


_ASKED = f"'{QUESTION.lower()}'"


_RELATED = rf"""{_NAMES}, q AS (SELECT {_ASKED} AS low, ' ' || regexp_replace({_ASKED}, '([^a-z0-9])', '\1\1', 'g') || ' ' AS wide),
c AS (SELECT id, sum(CASE WHEN whole AND length(k) < 3 AND k <> 'ai' THEN 0 ELSE {_TIMES} END) AS score FROM p, q GROUP BY id),
h AS (SELECT e.*, c.score FROM ent e JOIN c USING (id) WHERE score > 0),
o AS (SELECT DISTINCT {_KEY.format('x')} AS k FROM (SELECT unnest(list_concat([name], aliases)) AS x FROM h WHERE type = 'person') WHERE x <> ''),
a AS (SELECT id, type, name, CAST(score AS INT) AS score, updated, ord FROM h UNION ALL SELECT id, type, name, 1, updated, ord FROM ent WHERE id NOT IN (SELECT id FROM h) AND type = 'commitment' AND status IN ('open', 'unknown') AND {_KEY.format('owner')} IN (SELECT k FROM o)),
rel AS (SELECT id, type, name, score, updated, ord FROM a ORDER BY score DESC, updated, ord LIMIT 40)"""


@query(f"WITH {ENT}, {_RELATED} SELECT id, type, name, score, updated FROM rel")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.relevant(store(spark, d), QUESTION).select("id", "type", "name", "score", "updated")


@query(f"""WITH {ENT} SELECT unnest(sources) AS meeting_id, CAST(count(*) * 3 AS BIGINT) AS boost FROM ent WHERE type = 'project' GROUP BY 1""")
def source_boost(spark: SparkSession, d: str) -> DataFrame:
    return entities.source_boost(store(spark, d).where("type = 'project'"))


@query(f"""WITH {ENT} SELECT id, f.text AS text, coalesce(f.fact_date, '') AS date, coalesce(f.source, '') AS source FROM (SELECT id, unnest(facts[greatest(len(facts) - 1, 1):]) AS f FROM ent)""")
def last_n_items(spark: SparkSession, d: str) -> DataFrame:
    return entities.last_facts(store(spark, d), 2)


@query(f"""WITH {ENT} SELECT id FROM ent WHERE len(facts) >= 4 OR length(summary) > 60""")
def tidy_targets(spark: SparkSession, d: str) -> DataFrame:
    return entities.tidy_targets(store(spark, d), 4, 60).select("id")


@query(f"""WITH {ENT}, r AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY ord) AS n FROM ent WHERE type IN ('person', 'project', 'term'))
SELECT type, string_agg(name, ', ' ORDER BY n) AS names FROM r WHERE n <= 400 GROUP BY type""")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return entities.name_index(store(spark, d))


@query(f"""WITH {ENT}, k AS (SELECT type, {_KEY.format('name')} AS k, ord, id FROM ent) SELECT arg_min(id, ord) AS id, count(*) AS n FROM k GROUP BY type, k""")
def dedupe_entities(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    one = entities.deduplicated(e).select("id", "type", T.norm_name(F.col("name")).alias("k"))
    n = e.groupBy("type", T.norm_name(F.col("name")).alias("k")).agg(F.count("*").alias("n"))
    return one.join(n, ["type", "k"]).select("id", "n")


@query()
def upsert_batch(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    batch = e.where("type != 'term'").select(
        "type", "name", F.slice("aliases", 1, 1).alias("aliases"), F.lit("").alias("summary"),
        F.transform(F.slice("facts", 1, 1), lambda f: F.struct(F.concat(f["text"], F.lit(" (again)")).alias("text"), F.lit("2026-06-01").alias("date"), F.lit("").alias("source"))).alias("facts"),
        F.lit("done").alias("status"), F.lit("").alias("owner"), F.lit("").alias("due"), F.col("ord").alias("n"),
    )
    out = entities.upserted(e, batch, "2026-06-01T00:00:00")
    return out.select("id", "type", "status", F.size("aliases").alias("n_aliases"), F.size("facts").alias("n_facts"), "updated")


@query(f"""WITH {ENT} SELECT id, type, CASE WHEN type = 'commitment' AND status = 'open' THEN 'done' ELSE status END AS status, CASE WHEN status = 'open' THEN 'now' ELSE updated END AS updated FROM ent""")
def update_entities(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    c = e.where("status = 'open'").select("id", F.lit("done").alias("status"))
    return entities.updated(e, c, "now").select("id", "type", "status", "updated")


@query(f"""WITH {ENT} SELECT id FROM ent WHERE type <> 'term'""")
def delete_entities(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    return entities.removed(e, e.where("type = 'term'")).select("id")


@query(f"""WITH {ENT}, w AS (SELECT *, row_number() OVER v AS n, first(id) OVER v AS into_id FROM (SELECT *, {_KEY.format('name')} AS k FROM ent) WINDOW v AS (PARTITION BY type, k ORDER BY ord)),
d AS (SELECT * FROM w WHERE n = 2)
SELECT e.id, array_to_string(CASE WHEN d.id IS NULL THEN e.aliases ELSE list_concat(e.aliases, list_filter(list_concat([d.name], d.aliases), lambda x: x <> '' AND NOT list_contains(list_transform(list_concat([e.name], e.aliases), lambda y: {_KEY.format('y')}), {_KEY.format('x')}))) END, '|') AS aliases,
 CAST(CASE WHEN d.id IS NULL THEN len(e.facts) ELSE len(e.facts) + len(d.facts) + CASE WHEN d.summary <> '' AND e.summary <> '' AND NOT contains(e.summary, d.summary) THEN 1 ELSE 0 END END AS INT) AS n_facts,
 CASE WHEN d.id IS NULL THEN e.updated ELSE 'now' END AS updated FROM ent e LEFT JOIN d ON d.into_id = e.id WHERE e.id NOT IN (SELECT id FROM d)""")
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    e = store(spark, d)
    w = Window.partitionBy("type", T.norm_name(F.col("name"))).orderBy("ord")
    pairs = e.withColumn("n", F.row_number().over(w)).withColumn("into", F.first("id").over(w)).where("n = 2").select("id", "into")
    return entities.folded_into(e, pairs, "now").select("id", F.array_join("aliases", "|").alias("aliases"), F.size("facts").alias("n_facts"), "updated")


@query(f"""WITH {ENT} SELECT id, '- **' || name || '**' || CASE WHEN len(aliases) > 0 THEN '（' || array_to_string(aliases, '、') || '）' ELSE '' END
 || CASE WHEN type = 'commitment' THEN ' · ' || CASE WHEN status = '' THEN 'unknown' ELSE status END || CASE WHEN owner <> '' THEN ' · ' || owner ELSE '' END || CASE WHEN due <> '' THEN ' · ' || due ELSE '' END ELSE '' END
 || CASE WHEN summary <> '' THEN '：' || regexp_replace(summary, '：+$', '') ELSE '' END AS line FROM ent""")
def entity_lines(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).select("id", markdown.entry_line().alias("line"))


@query(f"""WITH {ENT} SELECT CAST(list_position(['person', 'project', 'commitment', 'term'], type) AS INT) AS kind_no, count(*) + sum(len(facts)) + 1 AS lines FROM ent GROUP BY type""")
def markdown_store(spark: SparkSession, d: str) -> DataFrame:
    return markdown.to_lines(store(spark, d)).groupBy("kind_no").agg(F.count("*").alias("lines"))


@query(f"""WITH {ENT}, l AS (SELECT id, type, name, facts, lower(right({_LINE}, 60)) AS p FROM ent WHERE type IN ('term', 'commitment'))
SELECT id AS doc_id, type, name, CASE WHEN type = 'term' THEN '' ELSE {_SAYS} END AS status, CAST(len(facts) AS INT) AS n_facts FROM l""")
def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Commitments' and terms' lines read back, one small text for each entry."""
    e = store(spark, d).where("type in ('term', 'commitment')")
    head = F.when(F.col("type") == "term", "## Terms\n").otherwise("## Commitments & decisions\n")
    md = e.select(F.col("id").alias("doc_id"), F.concat(head, F.array_join(F.concat(F.array(markdown.entry_line()), F.transform("facts", markdown.fact_line)), "\n")).alias("content"))
    return markdown.from_markdown(md, "2026-01-01T00:00:00").select("doc_id", "type", "name", "status", F.size("facts").alias("n_facts"))


# --- ranking and budgets -----------------------------------------------------------------------------------------

_COUNT = "CAST((length({0}) - length(replace({0}, {1}, ''))) / length({1}) AS INT)"


@query(f"""WITH {MEET}, r AS (SELECT m.*, lower(md_text) AS body, lower(title || ' ' || digest) AS head FROM m JOIN transcripts t USING (meeting_id) WHERE length(md_text) > 0), k AS (SELECT unnest(['budget', 'roadmap', 'budget']) AS k)
SELECT meeting_id, CAST(sum({_COUNT.format('head', 'k')} * 5 + least({_COUNT.format('body', 'k')}, 20)) AS INT) AS score FROM r, k GROUP BY meeting_id""")
def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(ranking.relevance(readable(spark, d), "budget, roadmap and the budget?")).select("meeting_id", "score")


@query(f"""WITH {MEET}, r AS (SELECT m.*, lower(md_text) AS body, lower(title || ' ' || digest) AS head FROM m JOIN transcripts t USING (meeting_id) WHERE length(md_text) > 0), k AS (SELECT unnest(['dorothea', 'budget', 'roadmap']) AS k),
s AS (SELECT meeting_id, date, created, body, head, CAST(sum({_COUNT.format('head', 'k')} * 5 + least({_COUNT.format('body', 'k')}, 20)) AS INT) AS score FROM r, k GROUP BY ALL), b AS (SELECT * FROM s ORDER BY score DESC, date DESC, created DESC, meeting_id DESC LIMIT 6),
h AS (SELECT meeting_id, score, 'relevance' AS how FROM b WHERE regexp_matches(body || head, 'dorothea|budget|roadmap')), l AS (SELECT meeting_id, 0 AS score, 'recent' AS how FROM r ORDER BY date DESC, created DESC, meeting_id DESC LIMIT 3)
SELECT * FROM h UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM h)""")
def related_meetings(spark: SparkSession, d: str) -> DataFrame:
    return ranking.related(readable(spark, d), "Dorothea", "budget roadmap")


_WORDS = f"""list_filter(regexp_split_to_array(title, '[\\s,，。、;；:：?？!！/()（）"“”‘’''\\[\\]]+'), lambda w: length(w) >= 2 AND lower(w) NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)}))"""


@query(f"""WITH {MEET}, w AS (SELECT meeting_id, {_WORDS} AS w FROM m)
SELECT meeting_id, array_to_string(list_concat(w, flatten(list_transform(list_filter(w, lambda x: regexp_full_match(x, '[㐀-鿿]{{4,}}')), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2))))), ' ') AS words FROM w""")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return meetings(spark, d).select("meeting_id", F.array_join(T.keywords(F.col("title")), " ").alias("words"))


@query(f"""WITH {MEET}, r AS (SELECT substr(date, 1, 7) AS month, meeting_id, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY date DESC, created DESC, meeting_id DESC) AS k, length(md_text) AS n FROM m JOIN transcripts USING (meeting_id) WHERE length(md_text) > 0)
SELECT month, meeting_id, CAST(sum(n + 1) OVER (PARTITION BY month ORDER BY k) AS BIGINT) AS used FROM r QUALIFY sum(n + 1) OVER (PARTITION BY month ORDER BY k) - 1 <= 12000""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    r = _by_month(spark, d)
    return budget.prefix(r, ["month"], ["k"], "n", 12_000, gap=1).select("month", "meeting_id", "used")


def _by_month(spark: SparkSession, d: str) -> DataFrame:
    m = readable(spark, d).withColumn("month", F.substring("date", 1, 7)).select("month", "meeting_id", "date", "created", F.length("content").alias("n"), "content")
    w = Window.partitionBy("month").orderBy(F.desc("date"), F.desc("created"), F.desc("meeting_id"))  # a month of meetings
    return m.withColumn("k", F.row_number().over(w))


@query(f"""WITH RECURSIVE {MEET}, r AS (SELECT substr(date, 1, 7) AS month, meeting_id, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY date DESC, created DESC, meeting_id DESC) AS k, length(md_text) AS n FROM m JOIN transcripts USING (meeting_id) WHERE length(md_text) > 0),
g AS (SELECT month, k, meeting_id, n AS used, true AS taken FROM r WHERE k = 1
 UNION ALL SELECT r.month, r.k, r.meeting_id, CASE WHEN g.used < 12000 AND g.used + r.n <= 12000 THEN g.used + r.n ELSE g.used END, g.used < 12000 AND g.used + r.n <= 12000 FROM g JOIN r ON r.month = g.month AND r.k = g.k + 1)
SELECT month, meeting_id FROM g WHERE taken""")
def budget_greedy_skip(spark: SparkSession, d: str) -> DataFrame:
    return budget.greedy(_by_month(spark, d), ["month"], "k", "n", 12_000).select("month", "meeting_id")


@query(f"""WITH {MEET}, r AS (SELECT substr(date, 1, 7) AS month, meeting_id, row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY date DESC, created DESC, meeting_id DESC) AS k, left(md_text, 3000) AS t FROM m JOIN transcripts USING (meeting_id) WHERE length(md_text) > 0),
b AS (SELECT *, sum(length(t)) OVER (PARTITION BY month ORDER BY k) - length(t) AS before FROM r)
SELECT month, meeting_id, CAST(least(length(t), 10000 - before) AS INT) AS chars FROM b WHERE before < 10000""")
def budget_context(spark: SparkSession, d: str) -> DataFrame:
    r = _by_month(spark, d).select("month", "k", "meeting_id", "content")
    return budget.concatenated(r, ["month"], ["k"], "content", 10_000, 3_000).select("month", "meeting_id", F.length("content").alias("chars"))


@query(f"""WITH {ENT} SELECT id, name FROM ent WHERE type = 'commitment' AND status IN ('open', 'unknown') ORDER BY ord DESC LIMIT 60""")
def open_commitments(spark: SparkSession, d: str) -> DataFrame:
    return analyses.open_commitments(store(spark, d)).select("id", "name")


def _memory_sql(limit: int) -> str:
    fact = "array_to_string(list_transform(list_filter(e.facts[greatest(len(e.facts) - 1, 1):], lambda f: coalesce(f.text, '') <> ''), lambda f: CASE WHEN coalesce(f.fact_date, '') <> '' THEN f.fact_date || ' ' ELSE '' END || left(f.text, 120)), '；')"
    return f"""WITH RECURSIVE {ENT}, {_RELATED}, b AS (SELECT list_position(['person', 'project', 'commitment', 'term'], rel.type) AS kind_no, rel.score, rel.updated, rel.ord, {fact} AS fact, sources, {_LINE} AS line
 FROM rel JOIN (SELECT id, aliases, status, owner, due, summary, facts, sources FROM ent) e USING (id)),
s AS (SELECT kind_no, line || CASE WHEN fact <> '' THEN ' ' || fact ELSE '' END || CASE WHEN len(sources) > 0 THEN ' [' || sources[-1] || ']' ELSE '' END AS line, row_number() OVER (ORDER BY kind_no, score DESC, updated, ord) AS rn FROM b),
f AS (SELECT 0::BIGINT AS rn, 0 AS used, 0 AS closed, 0 AS kind_no, '' AS line, false AS took
 UNION ALL SELECT s.rn, CASE WHEN fits THEN f.used + length(s.line) ELSE f.used END, CASE WHEN NOT fits AND NOT (f.closed = s.kind_no OR f.used >= {limit}) THEN s.kind_no ELSE f.closed END, s.kind_no, s.line, fits
 FROM f JOIN s ON s.rn = f.rn + 1, LATERAL (SELECT NOT (f.closed = s.kind_no OR f.used >= {limit}) AND f.used + length(s.line) <= {limit} AS fits))
SELECT CAST(kind_no AS INT) AS kind_no, CAST(row_number() OVER (ORDER BY rn) - 1 AS INT) AS n, line FROM f WHERE took"""


@query(_memory_sql(6000))
def memory_context(spark: SparkSession, d: str) -> DataFrame:
    return analyses.memory_lines(store(spark, d), QUESTION)


@query(_memory_sql(700))
def memory_context_short(spark: SparkSession, d: str) -> DataFrame:
    """With a budget that ends every type before its last entry."""
    return analyses.memory_lines(store(spark, d), QUESTION, limit=700)


@query(f"""WITH {MEET} SELECT meeting_id, '- [' || meeting_id || '] ' || date || ' ' || title || CASE WHEN digest <> '' THEN ': ' || digest ELSE '' END AS line FROM m""")
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    return analyses.index_lines(meetings(spark, d))


# --- sequences ---------------------------------------------------------------------------------------------------

_SAID = r"""lower(regexp_replace(text, '[\s!！.。?？…\-—–,，、;；:：''"“”‘’()（）\[\]【】·•*~～　]+', '', 'g'))"""
_REASON = f"""CASE WHEN regexp_full_match(text, '[\\s!！.。?？…\\-—–,，、;；:：''"“”‘’()（）\\[\\]【】·•*~～]*') THEN 'punctuation'
 WHEN regexp_matches(lower(text), '{'|'.join(r.replace(chr(39), chr(39) * 2) for r in sequence.INVENTED).lower().replace(chr(92) + 's', chr(92) + 's')}') THEN 'phrase'
 WHEN ns > 0.5 AND regexp_matches(lower(trim(text)), '{'|'.join(sequence.PERHAPS_INVENTED)}') THEN 'phrase'
 WHEN ns > 0.85 AND length({_SAID}) <= CASE WHEN regexp_matches({_SAID}, '[぀-ヿ㐀-鿿가-힯]') THEN 6 ELSE 12 END AND (lp IS NULL OR lp < -0.7) THEN 'silence'
 WHEN ns > 0.6 AND lp < -1.0 THEN 'silence' ELSE '' END"""
_CLEAN = f"""WITH {SEG}, c AS (SELECT meeting_id, seg_idx, text, CASE WHEN isnan(no_speech_prob) THEN NULL ELSE no_speech_prob END AS ns, CASE WHEN isnan(avg_logprob) THEN NULL ELSE avg_logprob END AS lp FROM seg),
r AS (SELECT meeting_id, seg_idx, {_SAID} AS said, {_REASON} AS reason FROM c),
k AS (SELECT *, CASE WHEN said = '' OR lag(said) OVER w IS DISTINCT FROM said THEN 1 ELSE 0 END AS fresh FROM r WHERE reason = '' WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS run FROM k),
n AS (SELECT meeting_id, seg_idx, CASE WHEN row_number() OVER (PARTITION BY meeting_id, run ORDER BY seg_idx) > 2 THEN 'repeat' ELSE '' END AS reason FROM g)
SELECT meeting_id, seg_idx, reason FROM n UNION ALL SELECT meeting_id, seg_idx, reason FROM r WHERE reason <> ''"""


@query(_CLEAN)
def repeat_collapse(spark: SparkSession, d: str) -> DataFrame:
    return sequence.cleaned(segments(spark, d)).select("meeting_id", "seg_idx", "reason")


@query(f"SELECT reason, count(*) AS n FROM ({_CLEAN}) WHERE reason <> '' GROUP BY reason")
def removed_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return sequence.removed_by_reason(sequence.cleaned(segments(spark, d)))


#: Segments as a speech engine leaves them on silence and music: invented, empty and repeated texts, by the segment's number.
_NOISY = _CLEAN.replace(SEG, "seg AS (SELECT * REPLACE (CASE WHEN seg_idx % 11 = 0 THEN '…' WHEN seg_idx % 13 = 0 THEN 'Thanks for watching!' WHEN seg_idx % 17 = 0 THEN 'Thank you.' WHEN seg_idx % 5 IN (1, 2, 3) THEN 'word ' || seg_idx // 5 ELSE text END AS text, CASE WHEN seg_idx % 17 = 0 THEN 0.7 WHEN seg_idx % 19 = 0 THEN 0.65 ELSE no_speech_prob END AS no_speech_prob, CASE WHEN seg_idx % 19 = 0 THEN -1.5 ELSE avg_logprob END AS avg_logprob) FROM segments QUALIFY row_number() OVER (PARTITION BY meeting_id, seg_idx ORDER BY received_at DESC, row_id DESC) = 1)")


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seg_idx")
    said = F.when(k % 11 == 0, "…").when(k % 13 == 0, "Thanks for watching!").when(k % 17 == 0, "Thank you.").when((k % 5).isin(1, 2, 3), F.concat(F.lit("word "), F.floor(k / 5).cast("string"))).otherwise(F.col("text"))
    silent = F.when(k % 17 == 0, 0.7).when(k % 19 == 0, 0.65).otherwise(F.col("no_speech_prob"))
    return segments(spark, d).withColumns({"text": said, "no_speech_prob": silent, "avg_logprob": F.when(k % 19 == 0, -1.5).otherwise(F.col("avg_logprob"))})


@query(_NOISY)
def noise_removed(spark: SparkSession, d: str) -> DataFrame:
    return sequence.cleaned(_noisy(spark, d)).select("meeting_id", "seg_idx", "reason")


@query(f"SELECT reason, count(*) AS n FROM ({_NOISY}) WHERE reason <> '' GROUP BY reason")
def noise_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return sequence.removed_by_reason(sequence.cleaned(_noisy(spark, d)))


@query(f"SELECT meeting_id AS doc_id, count(*) AS lines, count(*) FILTER (reason = '') AS kept FROM ({_NOISY}) GROUP BY meeting_id")
def clean_preview(spark: SparkSession, d: str) -> DataFrame:
    """What cleaning would leave of each transcript; confidences are unknown to its lines, so they are known here by text."""
    s = sequence.cleaned(_noisy(spark, d))
    return s.groupBy(F.col("meeting_id").alias("doc_id")).agg(F.count("*").alias("lines"), F.count_if(F.col("reason") == "").alias("kept"))


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, seg_idx, start_sec, CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END AS e FROM seg WHERE start_sec IS NOT NULL)
SELECT meeting_id, seg_idx, start_sec, coalesce(e, lead(start_sec) OVER (PARTITION BY meeting_id ORDER BY seg_idx), start_sec + 5) AS end_sec FROM t""")
def fill_ends(spark: SparkSession, d: str) -> DataFrame:
    return sequence.filled_ends(segments(spark, d)).select("meeting_id", "seg_idx", "start_sec", "end_sec")


_PIECES = f"""{SEG}, p AS (SELECT meeting_id AS recording_id, seg_idx // 10 AS piece, CAST(seg_idx % 10 AS INT) AS n, CAST(seg_idx // 10 AS DOUBLE) * 60 AS "offset", 60.0::DOUBLE AS duration, CAST((seg_idx % 10) * 8 AS DOUBLE) AS sec FROM seg)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of ten to a piece of a minute, with stamps every eight seconds that run past its end."""
    s = segments(spark, d)
    piece = F.floor(F.col("seg_idx") / 10)
    return s.select(
        F.col("meeting_id").alias("recording_id"), piece.alias("piece"), (F.col("seg_idx") % 10).cast("int").alias("n"), (piece.cast("double") * 60).alias("offset"),
        F.lit(60.0).alias("duration"), ((F.col("seg_idx") % 10) * 8).cast("double").alias("sec"), "text",
    )


@query(f"""WITH {_PIECES}, t AS (SELECT *, max(sec) OVER (PARTITION BY recording_id, piece) AS top FROM p),
a AS (SELECT *, "offset" + least(sec * CASE WHEN top > duration * 1.02 THEN duration * 0.98 / top ELSE 1 END, duration) AS pos FROM t),
s AS (SELECT *, round(max(pos) OVER (PARTITION BY recording_id ORDER BY piece, n), 2) AS start_sec FROM a),
e AS (SELECT *, lead(start_sec) OVER (PARTITION BY recording_id ORDER BY piece, n) AS nxt FROM s)
SELECT recording_id, piece, n, start_sec, round(greatest(CASE WHEN nxt <= "offset" + duration THEN nxt ELSE "offset" + duration END, start_sec + 0.5), 2) AS end_sec FROM e""")
def timeline_assemble(spark: SparkSession, d: str) -> DataFrame:
    return sequence.assembled(_pieces(spark, d)).select("recording_id", "piece", "n", "start_sec", "end_sec")


@query(f"""WITH {SEG} SELECT meeting_id AS recording_id, seg_idx AS idx, round(coalesce(sum(length(text)) OVER (PARTITION BY meeting_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2)::DOUBLE AS "offset" FROM seg""")
def prefix_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = segments(spark, d).select(F.col("meeting_id").alias("recording_id"), F.col("seg_idx").alias("idx"), F.length("text").cast("double").alias("duration"))
    return sequence.offsets(c).select("recording_id", "idx", "offset")


@query(f"""WITH RECURSIVE {SEG}, b AS (SELECT meeting_id, seg_idx, start_sec, coalesce(CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END, start_sec) AS e, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t, coalesce(is_gap, false) OR coalesce(speaker, '') <> '' AS lone
 FROM seg WHERE trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND start_sec IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS k, lag(lone) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS plone, lag(e) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS pe FROM b),
f AS (SELECT meeting_id, k, seg_idx AS first_idx, start_sec, e AS end_sec, t AS text, 1 AS pieces, 1 AS grp FROM r WHERE k = 1
 UNION ALL SELECT r.meeting_id, r.k, CASE WHEN j THEN first_idx ELSE r.seg_idx END, CASE WHEN j THEN o.start_sec ELSE r.start_sec END, r.e,
  CASE WHEN j THEN o.text || CASE WHEN regexp_matches(o.text, '[㐀-鿿]$') AND regexp_matches(r.t, '^[㐀-鿿]') THEN '，' WHEN regexp_matches(o.text, '[　-〿＀-￯]$') THEN '' ELSE ' ' END || r.t ELSE r.t END,
  CASE WHEN j THEN o.pieces + 1 ELSE 1 END, CASE WHEN j THEN o.grp ELSE o.grp + 1 END
  FROM (SELECT f.*, r.k AS k2, NOT r.lone AND NOT r.plone AND r.start_sec - r.pe <= 1.2 AND length(f.text) + length(r.t) <= (CASE WHEN regexp_matches(r.t, '[㐀-鿿]') THEN 110 ELSE 320 END)
   AND NOT (length(f.text) >= 0.45 * (CASE WHEN regexp_matches(r.t, '[㐀-鿿]') THEN 110 ELSE 320 END) AND regexp_matches(f.text, '[。！？!?.]$')) AS j FROM f JOIN r ON r.meeting_id = f.meeting_id AND r.k = f.k + 1) o JOIN r ON r.meeting_id = o.meeting_id AND r.k = o.k2)
SELECT meeting_id, first_idx, start_sec, end_sec, text, CAST(pieces AS INT) AS pieces FROM f QUALIFY row_number() OVER (PARTITION BY meeting_id, grp ORDER BY k DESC) = 1""")
def merge_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.merged(segments(spark, d))


@query(r"""WITH RECURSIVE l AS (SELECT meeting_id, length(md_text) AS chars_before, unnest(range(1, len(string_split(md_text, chr(10))) + 1)) AS k, len(string_split(md_text, chr(10))) AS n, unnest(string_split(md_text, chr(10))) AS line FROM transcripts WHERE md_text IS NOT NULL),
p AS (SELECT *, regexp_matches(line, '^\[\d+:\d{2}(:\d{2})?\]\s*') AS st, trim(regexp_replace(line, '^\[\d+:\d{2}(:\d{2})?\]\s*', ''), chr(32) || chr(9) || chr(13)) AS said, length(regexp_extract(line, '^\[\d+:\d{2}(:\d{2})?\]')) + 1 AS head FROM l WHERE NOT (k = n AND line = '')),
f AS (SELECT meeting_id, k, CASE WHEN st THEN said END AS held, CASE WHEN st THEN head + length(said) ELSE length(line) END AS chars FROM p WHERE k = 1
 UNION ALL SELECT p.meeting_id, p.k, CASE WHEN p.st THEN CASE WHEN j THEN o.held || sep || p.said ELSE p.said END END, o.chars + CASE WHEN j THEN length(sep || p.said) WHEN p.st THEN 1 + p.head + length(p.said) ELSE 1 + length(p.line) END
 FROM (SELECT f.*, coalesce(x.st AND f.held IS NOT NULL AND length(f.held) + length(x.said) <= 160 AND NOT regexp_matches(x.said, '^[^:：]{1,24}[:：]'), false) AS j,
  CASE WHEN regexp_matches(f.held, '[㐀-鿿]$') AND regexp_matches(x.said, '^[㐀-鿿]') THEN '，' WHEN regexp_matches(f.held, '[　-〿＀-￯]$') THEN '' ELSE ' ' END AS sep FROM f JOIN p x ON x.meeting_id = f.meeting_id AND x.k = f.k + 1) o JOIN p ON p.meeting_id = o.meeting_id AND p.k = o.k + 1)
SELECT t.meeting_id, CAST(length(md_text) AS INT) AS chars_before, CAST(coalesce(m.chars, 0) AS INT) AS chars_after FROM transcripts t LEFT JOIN (SELECT meeting_id, max_by(chars, k) AS chars FROM f GROUP BY 1) m USING (meeting_id) WHERE md_text IS NOT NULL""")
def compact_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.compact_transcripts(table(spark, d, "transcripts"), "meeting_id", "md_text").select("meeting_id", "chars_before", F.length("text").alias("chars_after"))


@query(r"""WITH l AS (SELECT meeting_id, unnest(range(1, len(string_split(md_text, chr(10))) + 1)) AS k, trim(unnest(string_split(md_text, chr(10))), chr(32) || chr(9) || chr(13)) AS line FROM transcripts WHERE md_text IS NOT NULL),
t AS (SELECT *, regexp_matches(line, '^\[\d{1,2}:\d{2}(:\d{2})?\]') AS stamped, regexp_extract(line, '^\[(\d{1,2}):(\d{2})(?::(\d{2}))?\]', ['a', 'b', 'c']) AS p FROM l WHERE line <> ''),
g AS (SELECT *, sum(CASE WHEN stamped THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY k) AS grp, CASE WHEN stamped THEN trim(regexp_replace(line, '^\[\d{1,2}:\d{2}(:\d{2})?\]', '')) ELSE line END AS said FROM t),
c AS (SELECT *, lag(said) OVER (PARTITION BY meeting_id, grp ORDER BY k) AS before FROM g WHERE said <> ''),
s AS (SELECT meeting_id, grp, sum(length(said) + CASE WHEN before IS NULL OR regexp_matches(before, '[　-鿿＀-￯]$') THEN 0 ELSE 1 END) AS chars FROM c GROUP BY 1, 2),
h AS (SELECT meeting_id, grp, max(CASE WHEN stamped THEN CASE WHEN p.c <> '' THEN CAST(p.a AS INT) * 3600 + CAST(p.b AS INT) * 60 + CAST(p.c AS INT) ELSE CAST(p.a AS INT) * 60 + CAST(p.b AS INT) END ELSE 0 END) AS sec FROM g GROUP BY 1, 2)
SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY grp) - 1 AS INT) AS n, sec, CAST(chars AS INT) AS chars FROM s JOIN h USING (meeting_id, grp)""")
def transcript_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.paragraphs(table(spark, d, "transcripts").where("md_text is not null"), "meeting_id", "md_text").select("meeting_id", "n", "sec", F.length("text").alias("chars"))


@query(f"""WITH RECURSIVE {SEG}, t AS (SELECT meeting_id, seg_idx, start_sec, end_sec, lag(end_sec) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS p FROM seg WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(end_sec)),
q AS (SELECT meeting_id, round((start_sec + p) / 2, 2) AS s FROM t WHERE start_sec - p >= 1), w AS (SELECT meeting_id, max(end_sec) AS total FROM t GROUP BY 1),
c AS (SELECT meeting_id, total, -1 AS n, 0.0::DOUBLE AS cut FROM w
 UNION ALL SELECT meeting_id, total, n + 1, coalesce((SELECT arg_min(s, (abs(s - (c.cut + 1200)), s)) FROM q WHERE q.meeting_id = c.meeting_id AND s BETWEEN c.cut + 1110 AND c.cut + 1230), c.cut + 1200) FROM c WHERE c.cut + 1200 < total - 240)
SELECT meeting_id AS recording_id, CAST(n AS INT) AS n, round(cut, 2) AS cut FROM c WHERE n >= 0""")
def cut_points(spark: SparkSession, d: str) -> DataFrame:
    """Cuts of recordings at the pauses of three seconds and more between their segments."""
    s = segments(spark, d).where("start_sec is not null and not isnan(end_sec) and end_sec is not null")
    o = Ordered(s, ["meeting_id"], ["seg_idx"]).neighbour("p", F.col("end_sec"), -1)
    quiet = F.when(F.col("start_sec") - F.col("p.v") >= 1, F.round((F.col("start_sec") + F.col("p.v")) / 2, 2))
    r = o.df.groupBy(F.col("meeting_id").alias("recording_id")).agg(F.max("end_sec").alias("total"), F.array_sort(F.collect_list(quiet)).alias("silences"))
    return sequence.cuts(r)


@query(f"""SELECT user_id, round(greatest(quantile_cont(value, 0.2) * 4, 0.004), 6) AS "limit" FROM events GROUP BY user_id""")
def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    q = sequence.quantile(table(spark, d, "events"), ["user_id"], "value", "event_id", 0.2)
    return q.select("user_id", F.round(F.greatest(F.col("q") * 4, F.lit(0.004)), 6).alias("limit"))


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value AS rms FROM events),
l AS (SELECT user_id, greatest(quantile_cont(value, 0.2) * 4, 0.004) AS lim, count(*) AS n FROM events GROUP BY user_id),
b AS (SELECT f.user_id, k, rms > lim AS loud, n FROM f JOIN l USING (user_id)),
w AS (SELECT *, lag(loud) OVER o AS p, lead(loud) OVER o AS q, lead(loud, 2) OVER o AS r FROM b WINDOW o AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT user_id, max(n) AS n, min(CASE WHEN loud AND q AND r THEN k END) AS onset, max(CASE WHEN loud AND p AND k > 1 THEN k END) AS last FROM w GROUP BY user_id)
SELECT user_id, round(CASE WHEN onset IS NULL OR n < 10 THEN 0 ELSE greatest(0, onset * 0.1 - 0.5) END, 3)::DOUBLE AS start, round(CASE WHEN onset IS NULL OR n < 10 THEN n * 0.1 ELSE least(n * 0.1, (coalesce(last, n - 1) + 1) * 0.1 + 1.0) END, 3)::DOUBLE AS "end" FROM g""")
def speech_bounds(spark: SparkSession, d: str) -> DataFrame:
    f = _numbered(spark, d).select("user_id", (F.col("n") - 1).alias("frame"), F.col("value").alias("rms"))
    return sequence.speech_bounds(f, ["user_id"])


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Events with their number (n, from 1) in the order of each user's."""
    return Ordered(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).running_sum("n", F.lit(1)).df


@query("""WITH t AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[㐀-鿿]', '', 'g')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]+')) AS latin FROM documents)
SELECT doc_id, CASE WHEN cjk = 0 AND latin = 0 THEN 'auto' WHEN cjk / 2 >= latin THEN CASE WHEN latin >= 30 AND latin / (cjk / 2) > 0.4 THEN 'zh+en' ELSE 'zh' END ELSE CASE WHEN cjk >= 60 AND cjk / 2 / latin > 0.4 THEN 'zh+en' ELSE 'en' END END AS mix FROM t""")
def language_mix(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", T.language_mix(F.col("content")).alias("mix"))


@query("""WITH s AS (SELECT meeting_id, CASE WHEN source = 'chat' THEN 'la' ELSE lang END AS lang, sum(n_chars / 1000.0) AS w FROM documents WHERE meeting_id IS NOT NULL GROUP BY 1, 2)
SELECT meeting_id, lang, round(w, 6)::DOUBLE AS weight FROM s QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY lang <> 'la' DESC, round(w, 6) DESC, lang DESC) = 1""")
def language_vote(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("source") == "chat", "la").otherwise(F.col("lang"))  # a language no meeting is in
    w = table(spark, d, "documents").where("meeting_id is not null").select("meeting_id", lang.alias("lang"), (F.col("n_chars") / 1000.0).alias("prob"))
    return sequence.language_vote(w, ["meeting_id"])


@query(rf"""WITH b AS (SELECT meeting_id, trim(regexp_replace(md_text, '(?s)^.*?\n\[', '['), chr(32) || chr(10)) AS t, length(md_text) * 1.0 AS duration FROM transcripts WHERE md_text IS NOT NULL)
SELECT meeting_id, regexp_matches(t, '^\[\d{{1,2}}:\d{{2}}(:\d{{2}})?\]') AND (len(regexp_extract_all(t, '(?m)^\[\d{{1,2}}:\d{{2}}(:\d{{2}})?\]')) >= duration / 180 OR regexp_matches(t, '{sequence.QUIET}')) AS valid FROM b""")
def valid_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts from their first stamp on, as if every character were a second."""
    t = table(spark, d, "transcripts").where("md_text is not null")
    return t.select("meeting_id", sequence.valid_piece(F.regexp_replace("md_text", r"(?s)^.*?\n\[", "["), F.length("md_text").cast("double")).alias("valid"))


# --- glossary ----------------------------------------------------------------------------------------------------


@query("SELECT section, count(*) AS n FROM glossary GROUP BY section")
def glossary_stats(spark: SparkSession, d: str) -> DataFrame:
    return glossary.counts(terms(spark, d))


@query("""WITH r AS (SELECT term, CASE WHEN len(wrong) > 0 THEN CASE WHEN section = 'terms' THEN 0 ELSE 1 END ELSE CASE WHEN section = 'names' THEN 2 ELSE 3 END END AS rank, ord FROM glossary),
f AS (SELECT term, min(rank * 1000 + ord) AS x FROM r GROUP BY term) SELECT term, CAST(x // 1000 AS INT) AS rank, CAST(x % 1000 AS INT) AS ord FROM f ORDER BY x LIMIT 15""")
def prompt_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.prompt_terms(terms(spark, d))


@query("""WITH u AS (SELECT section, ord, term, sum(length(term) + 1) OVER (ORDER BY section <> 'names', ord) AS used FROM glossary) SELECT section, ord, term, CAST(used AS BIGINT) AS used FROM u WHERE used <= 60""")
def capped_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.capped_terms(terms(spark, d), 60)


@query("""WITH w AS (SELECT section, ord, term, unnest(list_concat([term], wrong)) AS v FROM glossary)
SELECT DISTINCT doc_id, section, ord, term FROM documents JOIN w ON v <> '' AND contains(lower(text), lower(v))""")
def glossary_hits(spark: SparkSession, d: str) -> DataFrame:
    return glossary.hits(terms(spark, d), texts(spark, d))


@query("""WITH w AS (SELECT ord, term, unnest(wrong) AS w, unnest(range(1, len(wrong) + 1)) AS k FROM glossary WHERE section = 'names')
SELECT w AS wrong, arg_min(term, ord * 1000 + k) AS "right" FROM w WHERE w <> '' AND NOT contains(w, term) AND NOT contains(term, w) AND length(regexp_replace(w, '[^㐀-鿿]', '', 'g')) >= 3 AND NOT regexp_matches(w, '[A-Za-z]') GROUP BY w""")
def safe_replacements(spark: SparkSession, d: str) -> DataFrame:
    return glossary.safe_replacements(terms(spark, d))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'backlog', ''))) / 7 + (length(text) - length(replace(text, '发布清单', ''))) / 4 AS INT) AS n FROM documents""")
def corrected_texts(spark: SparkSession, d: str) -> DataFrame:
    return glossary.corrected(texts(spark, d), [("backlog", "Backlog"), ("发布清单", "上线清单")]).select("doc_id", "n")


# --- rendering and sources ---------------------------------------------------------------------------------------


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, seg_idx, start_sec, CASE WHEN speaker IS NOT NULL AND speaker <> '' AND NOT starts_with(lower(text), lower(speaker)) THEN speaker || ': ' || text ELSE text END AS x, CAST(floor(start_sec) AS BIGINT) AS s FROM seg WHERE coalesce(text, '') <> '')
SELECT meeting_id, seg_idx, CASE WHEN start_sec IS NULL THEN x WHEN s >= 3600 THEN '[' || (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '] ' || x ELSE '[' || lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '] ' || x END AS line FROM t""")
def render_lines(spark: SparkSession, d: str) -> DataFrame:
    return export.transcript_lines(segments(spark, d))


_CUE = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, seg_idx, start_sec, CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END AS e, CASE WHEN coalesce(speaker, '') <> '' AND NOT starts_with(lower(text), lower(speaker)) THEN speaker || ': ' || text ELSE text END AS x FROM seg WHERE coalesce(text, '') <> '' AND start_sec IS NOT NULL),
f AS (SELECT meeting_id, seg_idx, row_number() OVER w AS no, CAST(round(start_sec * 1000) AS BIGINT) AS a, CAST(round(coalesce(e, lead(start_sec) OVER w, start_sec + 5) * 1000) AS BIGINT) AS b, x FROM t WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx))
SELECT meeting_id, seg_idx, no || chr(10) || {_CUE.format('a')} || ' --> ' || {_CUE.format('b')} || chr(10) || x AS cue FROM f""")
def render_cues(spark: SparkSession, d: str) -> DataFrame:
    return export.cues(segments(spark, d))


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, seg_idx, CASE WHEN coalesce(speaker, '') <> '' AND NOT starts_with(lower(text), lower(speaker)) THEN speaker || ': ' || text ELSE text END AS line FROM seg WHERE coalesce(text, '') <> '')
SELECT meeting_id, 1 AS part, seg_idx AS n, line FROM t""")
def render_txt(spark: SparkSession, d: str) -> DataFrame:
    return export.rendered(meetings(spark, d), segments(spark, d), "txt")


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, seg_idx, start_sec, CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END AS e, CASE WHEN coalesce(speaker, '') <> '' AND NOT starts_with(lower(text), lower(speaker)) THEN speaker || ': ' || text ELSE text END AS x FROM seg WHERE coalesce(text, '') <> '' AND start_sec IS NOT NULL),
f AS (SELECT meeting_id, seg_idx, CAST(round(start_sec * 1000) AS BIGINT) AS a, CAST(round(coalesce(e, lead(start_sec) OVER w, start_sec + 5) * 1000) AS BIGINT) AS b, x FROM t WINDOW w AS (PARTITION BY meeting_id ORDER BY seg_idx))
SELECT meeting_id, 1 AS part, seg_idx AS n, replace({_CUE.format('a')} || ' --> ' || {_CUE.format('b')}, ',', '.') || chr(10) || x || chr(10) AS line FROM f
UNION ALL SELECT DISTINCT meeting_id, 0, 0, 'WEBVTT' || chr(10) FROM f""")
def render_vtt(spark: SparkSession, d: str) -> DataFrame:
    return export.rendered(meetings(spark, d), segments(spark, d), "vtt")


@query(f"""WITH {SEG}, t AS (SELECT meeting_id, CAST(count(*) FILTER (coalesce(text, '') <> '') AS BIGINT) AS said, CAST(floor(max(CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END)) AS BIGINT) AS x FROM seg GROUP BY 1)
SELECT meeting_id, 'done' AS status, CASE WHEN x IS NULL THEN '' WHEN x >= 3600 THEN (x // 3600) || ':' || lpad(CAST(x // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') ELSE lpad(CAST(x // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') END AS duration,
 said AS md_lines, said + 2 AS json_lines FROM t WHERE said > 0""")
def write_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """What the writing of transcripts gives: body lines, lines of the json twin, and the changed meta."""
    s = segments(spark, d)
    md, twin, meta = export.written(meetings(spark, d), s)
    count = lambda df, name: df.groupBy("meeting_id").agg(F.count("*").alias(name))
    return meta.join(count(md.where("part = 1"), "md_lines"), "meeting_id").join(count(twin, "json_lines"), "meeting_id")


@query(f"""WITH {MEET}, {ENT} SELECT (SELECT count(*) FROM m WHERE meeting_id IN (SELECT meeting_id FROM transcripts WHERE length(md_text) > 0)) AS meetings, (SELECT count(*) FROM ent WHERE type = 'person') AS persons, (SELECT count(*) FROM ent WHERE type = 'project') AS projects,
 (SELECT count(*) FROM ent WHERE type = 'commitment') AS promises, (SELECT count(*) FROM ent WHERE type = 'commitment' AND status = 'open') AS open, (SELECT count(*) FROM ent WHERE type = 'term') AS terms, (SELECT count(*) FROM glossary) AS glossary,
 (SELECT string_agg(name, ', ' ORDER BY ord) FROM (SELECT name, ord FROM ent WHERE type = 'person' ORDER BY ord LIMIT 400)) AS person_names""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return library.dashboard(library.with_transcript(meetings(spark, d), table(spark, d, "transcripts")), store(spark, d), terms(spark, d))


@query(f"""WITH {MEET} SELECT meeting_id FROM m WHERE meeting_id IN (SELECT meeting_id FROM transcripts WHERE length(md_text) > 0)""")
def has_transcript(spark: SparkSession, d: str) -> DataFrame:
    return library.with_transcript(meetings(spark, d), table(spark, d, "transcripts")).select("meeting_id")


@query(f"""WITH {ENT}, {MEET}, f AS (SELECT id, unnest(facts) AS f FROM ent), s AS (SELECT id, unnest(sources) AS s FROM ent)
SELECT e.id, CAST(len(e.facts) AS INT) AS n_facts, CAST((SELECT count(*) FROM f JOIN m ON m.meeting_id = f.f.source WHERE f.id = e.id) AS BIGINT) AS titled, CAST(len(e.sources) AS INT) AS n_sources, CAST((SELECT count(*) FROM s JOIN m ON m.meeting_id = s.s WHERE s.id = e.id) AS BIGINT) AS known FROM ent e""")
def entity_detail(spark: SparkSession, d: str) -> DataFrame:
    e = entities.detail(store(spark, d), meetings(spark, d))
    count = lambda c, test: F.size(F.filter(c, test)).cast("bigint")
    return e.select("id", F.size("facts").alias("n_facts"), count("facts", lambda f: f["source_title"] != "").alias("titled"), F.size("sources").alias("n_sources"), count("sources", lambda x: x["exists_flag"]).alias("known"))


@query("""WITH o AS (SELECT source AS kind, strftime(created, '%Y-%m-%d') AS name, text AS content, 0 AS late FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source, strftime(created, '%Y-%m-%d'), text, 1 FROM documents WHERE doc_id % 2 = 1),
r AS (SELECT kind, name, arg_max(content, (late, content)) AS content FROM o WHERE kind IN ('brief', 'weekly') GROUP BY 1, 2),
x AS (SELECT DISTINCT kind, name, content, late FROM o WHERE kind NOT IN ('brief', 'weekly'))
SELECT kind, count(*) AS docs, count(DISTINCT name) AS names FROM r GROUP BY 1 UNION ALL SELECT kind, count(*), count(*) FROM x GROUP BY 1""")
def filed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an odd number put to those with an even one, by day."""
    x = table(spark, d, "documents").select("doc_id", F.col("source").alias("kind"), F.date_format("created", "yyyy-MM-dd").alias("name"), F.col("text").alias("content"))
    return library.filed(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1")).groupBy("kind").agg(F.count("*").alias("docs"), F.countDistinct("name").alias("names"))


@query(f"""WITH {MEET} SELECT DISTINCT meeting_id, CASE WHEN length(title) % 2 = 0 THEN 'New: ' || meeting_id ELSE title END AS title, CASE WHEN length(title) % 3 = 0 THEN '2026-02-28' ELSE date END AS date, participants FROM m""")
def edited_meetings(spark: SparkSession, d: str) -> DataFrame:
    """Every second title changed, every third date; blank titles and dates that are none change nothing."""
    m = meetings(spark, d).select("meeting_id", "title", "date", "participants").distinct()
    n = F.length("title")
    c = m.select("meeting_id", F.when(n % 2 == 0, F.concat(F.lit(" New:  "), "meeting_id")).otherwise(" ").alias("title"), F.when(n % 3 == 0, "2026-02-28").otherwise("2026-02-30").alias("date"), F.lit(None).cast("string").alias("participants"))
    return library.edited(m, c)


@query(f"""WITH {SEG} SELECT meeting_id, round(max(CASE WHEN isnan(end_sec) THEN NULL ELSE end_sec END), 2) AS seconds FROM seg GROUP BY meeting_id""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return export.durations(segments(spark, d)).select("meeting_id", "seconds")


@query(f"""WITH {MEET}, {DOCS}, f AS (SELECT meeting_id, 0 AS o, '' AS name, 'transcript' AS type FROM transcripts UNION ALL SELECT meeting_id, 1, kind || '-' || name, 'report' FROM d WHERE meeting_id IS NOT NULL)
SELECT m.meeting_id, m.title, m.date, string_agg(type || ':' || f.name, '|' ORDER BY o, f.name) AS files FROM f JOIN m USING (meeting_id) GROUP BY 1, 2, 3""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("meeting_id", F.lit("transcript").alias("type"), F.lit("").alias("name"))
    r = docs(spark, d).where("meeting_id is not null").select("meeting_id", F.lit("report").alias("type"), F.concat_ws("-", "kind", "name").alias("name"))
    m = export.manifest(meetings(spark, d), t.unionByName(r))
    return m.select("meeting_id", "title", "date", F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["type"], x["name"])), "|").alias("files"))


@query("""SELECT meeting_id, CASE WHEN regexp_matches(md_text, '\\n- (Participants|参与人员)\\s*[:：]') THEN trim(regexp_extract(md_text, '\\n- (?:Participants|参与人员)\\s*[:：]\\s*([^\\n]*)', 1)) END AS participants FROM transcripts""")
def participants_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("meeting_id", export.participants_of(F.col("md_text")).alias("participants"))


@query()
def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    """Every import read by the format its content shows."""
    i = ingest.latest(table(spark, d, "imports"), ["import_id"], ["received_at"])
    p = readers.read_pasted(i.select(F.col("import_id").cast("string").alias("path"), "content"))
    return p.select(F.col("path").alias("import_id"), "format", F.size("segments").alias("segments"), F.length("text").alias("chars"), "error")


@query(r"""WITH i AS (SELECT import_id, content FROM imports QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY received_at DESC) = 1)
SELECT CAST(import_id AS VARCHAR) AS import_id, len(regexp_extract_all(content, '\d[\d:.,]*\s*-->\s*\d[\d:.,]*')) AS segments FROM i WHERE len(regexp_extract_all(content, '\d[\d:.,]*\s*-->\s*\d[\d:.,]*')) >= 2""")
def subtitle_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_imports(spark, d).where("format in ('srt', 'vtt')").select("import_id", F.col("segments").cast("bigint").alias("segments"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "bigint"), F.try_variant_get("v", "$.key", "bigint")).alias("k"))


# --- streams, as batches -----------------------------------------------------------------------------------------


@query(r"""WITH RECURSIVE c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events),
s AS (SELECT CAST(user_id AS VARCHAR) AS rec_id, n, CASE WHEN n % 7 = 0 THEN n - 3 WHEN n % 11 = 0 THEN n + 4 ELSE n - 1 - n // 7 - n // 11 + n // 77 END AS seq FROM c),
g AS (SELECT rec_id, n, seq, CASE WHEN seq = 0 THEN 1 ELSE 0 END AS nxt, CASE WHEN seq = 0 THEN 'ok' WHEN seq < 0 THEN 'dup' ELSE 'gap' END AS status FROM s WHERE n = 1
 UNION ALL SELECT s.rec_id, s.n, s.seq, CASE WHEN s.seq = g.nxt THEN g.nxt + 1 ELSE g.nxt END, CASE WHEN s.seq = g.nxt THEN 'ok' WHEN s.seq < g.nxt THEN 'dup' ELSE 'gap' END FROM g JOIN s ON s.rec_id = g.rec_id AND s.n = g.n + 1)
SELECT rec_id, n, seq, status FROM g""")
def dup_seq_guard(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    seq = F.when(n % 7 == 0, n - 3).when(n % 11 == 0, n + 4).otherwise(n - 1 - F.floor(n / 7) - F.floor(n / 11) + F.floor(n / 77))
    c = _numbered(spark, d).select(F.col("user_id").cast("string").alias("rec_id"), n.cast("bigint").alias("n")).withColumn("seq", seq.cast("bigint"))
    return ingest.guarded_batch(c)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS rec_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS chunks FROM s GROUP BY user_id, k""")
def idle_recordings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("user_id").cast("string").alias("rec_id"), "ts")
    return ingest.idle_recordings(c, "15 minutes").select("rec_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "chunks")


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def weekly_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.per_period(table(spark, d, "events"), "ts", "1 week", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(f"""WITH {SEG}, a AS (SELECT meeting_id, sum(length(text)) AS bytes FROM seg GROUP BY meeting_id), {MEET}
SELECT m.meeting_id, CASE WHEN status = 'recording' THEN 'new' ELSE status END AS status FROM m JOIN a USING (meeting_id)
WHERE meeting_id NOT IN (SELECT meeting_id FROM transcripts) AND (status IN ('new', 'transcribing') OR (status = 'recording' AND bytes >= 1024))""")
def to_resume(spark: SparkSession, d: str) -> DataFrame:
    a = segments(spark, d).groupBy("meeting_id").agg(F.sum(F.length("text")).alias("bytes"))
    return ingest.to_resume(meetings(spark, d), table(spark, d, "transcripts"), a)


@query(f"""WITH {SEG}, a AS (SELECT meeting_id, sum(length(text)) AS bytes FROM seg GROUP BY meeting_id), {MEET}, x AS (SELECT meeting_id, CASE WHEN length(title) % 3 = 0 THEN 'recording' WHEN length(title) % 3 = 1 THEN 'transcribing' ELSE status END AS status FROM m)
SELECT x.meeting_id, CASE WHEN status = 'recording' THEN 'new' ELSE status END AS status FROM x JOIN a USING (meeting_id)
WHERE meeting_id NOT IN (SELECT meeting_id FROM transcripts WHERE length(text) > 2000) AND (status IN ('new', 'transcribing') OR (status = 'recording' AND bytes >= 1024))""")
def resumed(spark: SparkSession, d: str) -> DataFrame:
    """to_resume with meetings cut off in every state, and short transcripts not counting as finished."""
    a = segments(spark, d).groupBy("meeting_id").agg(F.sum(F.length("text")).alias("bytes"))
    k = F.length("title") % 3
    m = meetings(spark, d).withColumn("status", F.when(k == 0, "recording").when(k == 1, "transcribing").otherwise(F.col("status")))
    return ingest.to_resume(m, table(spark, d, "transcripts").where(F.length("text") > 2000), a)


# --- text primitives ---------------------------------------------------------------------------------------------


@query(f"""WITH {ENT} SELECT id, {_KEY.format('name')} AS k, coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'x') AS slug FROM ent""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).select("id", T.norm_name(F.col("name")).alias("k"), T.slug(F.col("name")).alias("slug"))


@query("""WITH l AS (SELECT DISTINCT coalesce(lang, '') AS lang FROM imports), a(k, v) AS (VALUES ('en', 'en'), ('zh', 'zh-CN'), ('zh-cn', 'zh-CN'), ('zh-hans', 'zh-CN'), ('zh-sg', 'zh-CN'), ('cn', 'zh-CN'), ('fr', 'fr'), ('english', 'en'), ('chinese', 'zh-CN'), ('french', 'fr'))
SELECT lang, coalesce((SELECT v FROM a WHERE k = replace(lower(lang), '_', '-')), (SELECT v FROM a WHERE k = string_split(replace(lower(lang), '_', '-'), '-')[1])) AS code FROM l""")
def locale_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "imports").select(F.coalesce("lang", F.lit("")).alias("lang")).distinct().select("lang", T.locale_code(F.col("lang")).alias("code"))


@query("""SELECT DISTINCT coalesce(source, '') AS source, CASE coalesce(source, '') WHEN 'audio' THEN 'Recording' WHEN 'paste' THEN 'Pasted' ELSE coalesce(source, '') END AS label FROM meetings""")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    m = meetings(spark, d).select("source").distinct()
    return m.select("source", T.source_label(F.col("source"), {"audio": "Recording", "paste": "Pasted"}).alias("label"))


@query(f"""WITH {ENT}, t AS (SELECT id, lower(right(name || '. ' || summary, 60)) AS p FROM ent WHERE type = 'commitment')
SELECT id, CASE WHEN regexp_matches(p, '已取消|已放弃|作废|cancelled|canceled|dropped|annulé') THEN 'cancelled' WHEN regexp_matches(p, '已兑现|已完成|已生效|已部署|已定|已执行|done|fulfilled|completed|réalisé') THEN 'done'
 WHEN regexp_matches(p, '进行中|待办|待执行|待测试|待定|未兑现|推进中|in progress|open|pending|en cours') THEN 'open' ELSE 'unknown' END AS said FROM t""")
def said_status(spark: SparkSession, d: str) -> DataFrame:
    c = store(spark, d).where("type = 'commitment'")
    return c.select("id", T.status_of(F.concat("name", F.lit(". "), "summary")).alias("said"))


@query(f"""WITH {ENT} SELECT id, coalesce(sources[1], '') AS first_ref, len(sources) AS n_refs, regexp_extract(coalesce(sources[1], ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS ref_date, summary AS plain FROM ent
WHERE len(list_filter(sources, lambda s: length(s) NOT BETWEEN 4 AND 90)) = 0 AND NOT regexp_matches(summary, '\\s\\s|^\\s|\\s$|\\[')""")
def source_refs(spark: SparkSession, d: str) -> DataFrame:
    """Sources written behind the summaries as references, and read back out of the text."""
    e = store(spark, d).where(~F.exists("sources", lambda s: ~F.length(s).between(4, 90)) & ~F.col("summary").rlike(r"\s\s|^\s|\s$|\["))
    line = F.concat("summary", F.array_join(F.transform("sources", lambda s: F.concat(F.lit(" ["), s, F.lit("]"))), ""))
    r = e.select("id", line.alias("line"), T.refs(line).alias("refs"))
    return r.select("id", F.coalesce(F.get("refs", F.lit(0)), F.lit("")).alias("first_ref"), F.size("refs").cast("bigint").alias("n_refs"), T.date_in(F.get("refs", F.lit(0))).alias("ref_date"), T.strip_refs(F.col("line"), F.col("refs")).alias("plain"))


@query("""WITH p AS (SELECT DISTINCT participants FROM meetings WHERE participants <> ''), w AS (SELECT participants, list_filter(regexp_split_to_array(participants, '[、,，;；/\\s]+'), lambda w: length(w) >= 2) AS w FROM p)
SELECT participants, array_to_string(w, '|') AS words FROM w""")
def split_words(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "meetings").where("participants != ''").select("participants").distinct()
    return p.select("participants", F.array_join(T.words(F.col("participants")), "|").alias("words"))


@query("""WITH l AS (SELECT import_id, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT import_id, content FROM imports) WHERE contains(content, '<v '))
SELECT import_id, CAST(line_no AS INT) AS line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<v(?:\\.[^\\s>]+)*\\s+([^>]+)>', '\\1: ', 'g'), '</?v[^>]*>', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS caption FROM l WHERE contains(line, '<v ')""")
def captions(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "imports").select("import_id", "content").distinct().where(F.contains("content", F.lit("<v ")))
    lines = library.doc_lines(i, "import_id").where(F.contains("line", F.lit("<v ")))
    return lines.select("import_id", "line_no", T.clean_tags(F.col("line")).alias("caption"))


@query("""WITH n(stem) AS (SELECT DISTINCT source || '-1355' FROM documents UNION SELECT 'minutes-0930-2' UNION SELECT 'followup' UNION SELECT 'chat-12')
SELECT stem, CASE WHEN regexp_matches(stem, '-\\d{4}(-\\d+)?$') THEN (CASE regexp_replace(stem, '-\\d{4}(-\\d+)?$', '') WHEN 'minutes' THEN 'Minutes' ELSE regexp_replace(stem, '-\\d{4}(-\\d+)?$', '') END)
 || ' ' || regexp_extract(stem, '-(\\d{2})\\d{2}(-\\d+)?$', 1) || ':' || regexp_extract(stem, '-\\d{2}(\\d{2})(-\\d+)?$', 1) WHEN stem = 'followup' THEN 'Follow-up' ELSE stem END AS label FROM n""")
def report_labels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.concat("source", F.lit("-1355")).alias("stem")).unionByName(spark.createDataFrame([("minutes-0930-2",), ("followup",), ("chat-12",)], "stem string")).distinct()
    return n.select("stem", export.report_label(F.col("stem")).alias("label"))


@query(f"""WITH {MEET} SELECT meeting_id, string_agg(line, chr(10) ORDER BY k) AS head FROM (SELECT meeting_id, unnest([1, 2, 3, 4, 5]) AS k,
 unnest(['# ' || title, '- Date: ' || date, CASE WHEN duration <> '' THEN '- Duration: ' || duration END, '- Source: ' || source, '- Participants: ' || CASE WHEN trim(participants) <> '' THEN trim(participants) ELSE '(not recorded)' END]) AS line FROM m) WHERE line IS NOT NULL GROUP BY meeting_id""")
def transcript_heads(spark: SparkSession, d: str) -> DataFrame:
    h = export.header_lines(meetings(spark, d)).where(F.col("line").rlike("^# |^- "))
    return h.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("head"))


@query(f"""WITH {SEG} SELECT meeting_id, seg_idx, '**' || coalesce(nullif(speaker, ''), 'me') || '**' || chr(10) || chr(10) || text AS block FROM seg WHERE coalesce(text, '') <> ''""")
def chat_markdown(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("meeting_id", "seg_idx", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("me")).alias("role"), "text")
    return export.chat_blocks(s, ["meeting_id", "seg_idx"], "role", "text")


@query(f"""WITH {MEET}, {DOCS} SELECT (SELECT count(*) FROM m) AS meetings, (SELECT count(*) FROM transcripts WHERE length(md_text) > 0) AS transcripts, (SELECT count(*) FROM d WHERE meeting_id IS NOT NULL) AS reports, (SELECT count(*) FROM m WHERE error <> '') AS errors""")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return library.run_stats(meetings(spark, d), table(spark, d, "transcripts").where(F.length("md_text") > 0), docs(spark, d).where("meeting_id is not null"))


@query("""WITH b AS (SELECT import_id, strftime(received_at, '%Y-%m-%d') || '-' || import_id % 5 AS base FROM imports QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY received_at) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY import_id) AS k FROM b) SELECT import_id, base || CASE WHEN k > 1 THEN '-x' || k ELSE '' END AS new_id FROM r""")
def new_meeting_ids(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "imports").groupBy("import_id").agg(F.min("received_at").alias("at"))
    base = F.concat_ws("-", F.date_format("at", "yyyy-MM-dd"), (F.col("import_id") % 5).cast("string"))
    n = library.numbered_names(i.select("import_id", F.concat(base, F.lit("-x")).alias("base")), "import_id", "base")
    return n.select("import_id", F.regexp_replace(F.regexp_replace("unique_name", "-x-(\\d+)$", "-x$1"), "-x$", "").alias("new_id"))


@query("""SELECT 'people' AS path, 'People' AS text UNION ALL SELECT 'names', 'Noms' UNION ALL SELECT 'missing', 'sections.missing'""")
def localised(spark: SparkSession, d: str) -> DataFrame:
    from .functions import locale

    keys = spark.createDataFrame([("people", "de"), ("names", "fr"), ("missing", "en")], "path string, lang string")
    return keys.select("path", locale.text(F.concat(F.lit("sections."), "path"), F.col("lang")).alias("text"))


@query(f"""WITH {ENT} SELECT id, f.text AS fact FROM (SELECT id, unnest(facts[greatest(len(facts) - 2, 1):]) AS f FROM ent WHERE id IN (SELECT id FROM ({_entity_search_sql('roadmap')})))""")
def recall(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the entries a word finds: their last three facts."""
    e = store(spark, d)
    return entities.last_facts(e.join(entities.search(e, "roadmap").select("id"), "id", "leftsemi"), 3).select("id", F.col("text").alias("fact"))
