"""From recordings to the store: transcription, participants and glossary, with the model or engine passed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import connectors
from ..functions import text as T
from ..operators import glossary, markdown, sequence
from ..operators.ordered import Ordered
from ..schemas import SEGMENTS


#: What goes into the glossary's prompt: characters of the store's names, latest meetings, and of each.
NAMES_CHARS, RECENT_MEETINGS, RECENT_CHARS = 30_000, 6, 8_000


def transcribed(chunks: DataFrame, engine: connectors.Transcriber, known: DataFrame | None = None, replacements: list[tuple[str, str]] = (), parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(segments, recordings) of chunks (recording_id, idx, duration, payload).

    Pieces are transcribed apart, those already known are taken as they are, failed ones become gaps. Their paragraphs
    are laid on the recording's time line, names known to be misheard are put right, and invented lines are dropped.
    recordings has duration, gaps, removed lines, corrections and the language by its words.
    """
    from .. import runtime

    pieces = runtime.cut(connectors.transcribe_all(chunks, engine, known, parallel))
    timed = sequence.offsets(chunks.select("recording_id", "idx", "duration")).join(pieces, ["recording_id", "idx"])
    key = timed.withColumn("piece_key", F.concat_ws("\u0001", "recording_id", F.col("idx").cast("string")))
    paras = sequence.paragraphs(key.where("text is not null"), "piece_key", "text")
    laid = key.select("piece_key", "recording_id", F.col("idx").alias("piece"), "offset", "duration", "gap").join(paras, "piece_key").withColumn("sec", F.col("sec").cast("double"))
    line = sequence.assembled(laid).join(laid.select("recording_id", "piece", "n", "gap"), ["recording_id", "piece", "n"])
    fixed = line.select(F.struct("recording_id", "piece", "n").alias("doc_id"), F.col("text").alias("content"))
    right = glossary.corrected(fixed, list(replacements)).select("doc_id.recording_id", "doc_id.piece", F.col("doc_id.n").alias("n"), F.col("content").alias("text"), F.col("n").alias("fixed"))
    whole = line.drop("text").join(right, ["recording_id", "piece", "n"])
    numbered = Ordered(whole, ["recording_id"], ["piece", "n"]).running_sum("seg_idx", F.lit(1), exclusive=True).df
    nothing = F.lit(None)
    segs = numbered.select(
        F.col("recording_id").alias("meeting_id"), F.col("seg_idx").cast("bigint").alias("seg_idx"), "start_sec", "end_sec", "text", nothing.cast("string").alias("speaker"),
        F.col("gap").alias("is_gap"), nothing.cast("double").alias("no_speech_prob"), nothing.cast("double").alias("avg_logprob"), "fixed",
    )
    clean = sequence.cleaned(segs)
    kept = clean.where("reason = '' or is_gap").select([f.split()[0] for f in SEGMENTS.split(", ")])
    about = clean.groupBy(F.col("meeting_id").alias("recording_id")).agg(
        F.count_if(F.col("is_gap")).alias("gaps"), F.count_if((F.col("reason") != "") & ~F.col("is_gap")).alias("removed"), F.sum("fixed").alias("fixed"),
        F.sum(F.regexp_count("text", F.lit(T.CJK))).alias("cjk"), F.sum(F.regexp_count("text", F.lit("[A-Za-z]+"))).alias("latin"),
    )
    length = chunks.groupBy("recording_id").agg(F.round(F.sum("duration"), 2).alias("duration"))
    lang = F.when((F.col("cjk") == 0) & (F.col("latin") == 0), "auto").when(F.col("cjk") / 2 >= F.col("latin"), "zh").otherwise("en")
    return kept, length.join(about, "recording_id", "left").select("recording_id", "duration", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "removed", "fixed")], F.coalesce(lang, F.lit("auto")).alias("language"))


def participants(meetings: DataFrame, model: connectors.Model, sample: int = 20_000, most: int = 400) -> DataFrame:
    """(id, participants): who a model hears in the beginning of each transcript, one line of bounded length."""
    asked = meetings.where(F.length("content") > 0).select(F.col("meeting_id").alias("id"), F.lit("participants").alias("task"), F.substring("content", 1, sample).alias("prompt"))
    a = connectors.answer_all(asked, model)
    return a.select("id", F.substring(T.squeeze(F.coalesce("answer", F.lit(""))), 1, most).alias("participants"))


def extracted_glossary(old: str, store: DataFrame, recent: DataFrame, model: connectors.Model) -> str:
    """The glossary after a model has read the store's lines and the latest meetings; the old one if its answer fails.

    The answer must have both parts, and of a long glossary not lose more than four tenths.
    """
    lines = markdown.to_lines(store.where("type in ('person', 'project', 'term')"), facts=False).orderBy("kind_no", "ord", "line_no").limit(NAMES_CHARS)  # a line is a character at least
    names = "\n".join(r.line for r in lines.select("line").collect())[:NAMES_CHARS]
    texts = [r.content for r in recent.where(F.length("content") > 0).orderBy(F.desc("date")).limit(RECENT_MEETINGS).select(F.substring("content", 1, RECENT_CHARS).alias("content")).collect()]
    answer = model("\n\n".join(["<glossary>", old, "</glossary>", names, *texts]), "glossary")
    spark = store.sparkSession
    row = spark.createDataFrame([(old, answer)], "old string, new string").withColumn("new", T.strip_fence(F.col("new")))
    got = row.select("new", glossary.rewrite_allowed(F.col("old"), F.col("new")).alias("ok")).first()
    return got.new + "\n" if got.ok else old


def fixed_names(texts: DataFrame, model: connectors.Model) -> DataFrame:
    """(id, content, changed): texts with names put right by a model, where its answer is no other text."""
    asked = texts.select("id", F.lit("namefix").alias("task"), F.col("content").alias("prompt")).where((F.length("content") > 0) & (F.length("content") <= 80_000))
    a = connectors.answer_all(asked, model).select("id", "answer")
    ok = F.coalesce(glossary.name_fix_allowed(F.col("content"), F.col("answer")), F.lit(False))
    return texts.join(a, "id", "left").select("id", F.when(ok, F.col("answer")).otherwise(F.col("content")).alias("content"), (ok & (F.col("answer") != F.col("content"))).alias("changed"))
