"""Queries of the training-data problems, by problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import small, table
from . import encodings, languages, mails, mixing, names, packing, personal, pieces, turns


def limits(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of one row of the settings table."""
    r = table(spark, d, "size_limits").where(F.col("limit_name") == name).agg(F.max("max_tokens").alias("m"), F.max("overlap_tokens").alias("o")).first()
    return int(r.m), int(r.o or 0)


def imported(spark: SparkSession, d: str) -> DataFrame:
    """The imports as records; one delivered twice counts once."""
    return table(spark, d, "imports").groupBy("import_id").agg(F.min_by(F.struct("content", "lang", "meeting_id"), "received_at").alias("r")).select(
        F.lit("imports").alias("origin"), F.col("import_id").cast("string").alias("record_id"), F.col("r.content").alias("text"), F.col("r.lang").alias("lang"), F.col("r.meeting_id").alias("meeting_id")
    )


def transcribed(spark: SparkSession, d: str, column: str = "text") -> DataFrame:
    return table(spark, d, "transcripts").select(F.lit("transcripts").alias("origin"), F.col("meeting_id").alias("record_id"), F.col(column).alias("text"), "lang", "meeting_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.groups(table(spark, d, "knowledge"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(p1_groups(spark, d))


def spoken_lines(spark: SparkSession, d: str, words: bool = True) -> DataFrame:
    """Tagged lines; a segment delivered again counts once, by its latest delivery."""
    people = (
        table(spark, d, "meetings").select("meeting_id", "participants")
        .unionByName(table(spark, d, "rooms").select("meeting_id", "participants"))
        .groupBy("meeting_id")
        .agg(F.max("participants").alias("participants"))
    )
    people = small(people)
    raw = table(spark, d, "segments").select("meeting_id", "seg_idx", "start_sec", "speaker", "text", "received_at", "row_id")
    segments = (
        raw.groupBy("meeting_id", "seg_idx")
        .agg(F.max_by(F.struct("start_sec", "speaker", "text"), F.struct("received_at", "row_id")).alias("r"))
        .join(people, "meeting_id", "left")
        .select(F.col("meeting_id").alias("record_id"), "seg_idx", "r.start_sec", "r.speaker", "r.text", "participants")
    )
    texts = imported(spark, d).unionByName(transcribed(spark, d).join(raw.select("meeting_id").distinct(), "meeting_id", "leftanti").select("origin", "record_id", "text", "lang", "meeting_id"))
    return turns.lines_of(segments, texts.join(people, "meeting_id", "left"), words)


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(spoken_lines(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_starts(spoken_lines(spark, d, words=False))


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    lines = languages.sample_lines(table(spark, d, "documents"))
    clean = encodings.model_of(table(spark, d, "documents"))
    return languages.languages(imported(spark, d).unionByName(transcribed(spark, d)), languages.train(lines), clean)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(p3_languages(spark, d)).select("origin", "record_id", "first_line", "lang")


def personal_records(spark: SparkSession, d: str) -> DataFrame:
    """Texts of imports and transcripts, and every fact; an entry saved twice counts once."""
    texts = imported(spark, d).unionByName(transcribed(spark, d)).select("origin", "record_id", F.lit(-1).alias("fact_no"), "text")
    entries = table(spark, d, "knowledge").groupBy("entity_id").agg(F.max_by("facts", "updated").alias("facts"))
    facts = entries.select(F.lit("knowledge").alias("origin"), F.col("entity_id").alias("record_id"), F.posexplode(F.col("facts.text")).alias("fact_no", "text"))
    return texts.unionByName(facts)


def p4_mentions(spark: SparkSession, d: str) -> DataFrame:
    rooms, meetings = (table(spark, d, x).select("participants") for x in ("rooms", "meetings"))
    people = personal.people_of(rooms.unionByName(meetings), table(spark, d, "knowledge"))
    return personal.mentions(personal_records(spark, d), people)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(personal_records(spark, d), p4_mentions(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_mentions(spark, d).select("origin", "record_id", "fact_no", "start_pos", "kind")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    records = imported(spark, d).unionByName(transcribed(spark, d, "md_text"))
    return encodings.repairs(records, encodings.model_of(table(spark, d, "documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).select("origin", "record_id", "line_no")


def p6_written(spark: SparkSession, d: str) -> DataFrame:
    return mails.newly_written(table(spark, d, "imports"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_written(spark, d).select("import_id", "line_no")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), limits(spark, d, "container")[0])


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(p7_containers(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(p7_containers(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).where("short").select("source")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "documents"), *limits(spark, d, "piece"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 0").select("doc_id").distinct()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
