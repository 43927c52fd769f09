"""Sources as DataFrames: files of any import format, pasted texts, folders, stored documents and libraries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import runtime, schemas
from . import formats

PARSED = f"path string, ext string, format string, text string, segments array<struct<{schemas.SEGMENT.replace(' double', ':double').replace(' string', ':string')}>>, error string"


def _parse(data: bytes | str, ext: str) -> tuple[str, list[dict], str | None]:
    try:
        raw = formats.material(data, ext) if isinstance(data, bytes | bytearray) else data
        got = formats.imported(raw, "" if ext in formats.READERS else ext)
        return got["text"], got["segments"], None
    except formats.Unreadable as e:
        return "", [], str(e)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under path: text and segments of each, or the error that kept it from being read.

    Endings that are no text give no row. Reading and parsing run where the file's bytes are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    known = files.select("path", ext.alias("ext"), "content").where(F.col("ext").isin(*schemas.TEXT_RANK))
    return parse(known.select("path", "ext", "content"))


def read_pasted(texts: DataFrame) -> DataFrame:
    """Pasted texts (path as their key, content): the format is found from the content. Blank ones give no row."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            kind = [formats.format_of(x) for x in p.content]
            yield pd.DataFrame({"path": p.path, "ext": ["" if k == "text" else f".{k}" for k in kind], "content": p.content})

    runtime.ship(texts.sparkSession)
    kept = texts.where(F.length(F.trim("content")) > 0).select("path", "content")
    return parse(kept.mapInPandas(look, "path string, ext string, content string"))


def parse(raw: DataFrame) -> DataFrame:
    """(path, ext, content as text or bytes) to (path, ext, format, text, segments, error). Null content gives no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(path, ext, ext.lstrip(".") or "paste", *_parse(data, ext)) for path, ext, data in zip(p.path, p.ext, p.content, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "ext", "format", "text", "segments", "error"])

    runtime.ship(raw.sparkSession)
    return raw.where("content is not null").mapInPandas(run, PARSED)


def archived(files: DataFrame) -> DataFrame:
    """(path, archive_name): under which name a file that is read in stays beside what was made of it."""
    return files.select("path", F.concat(F.lit("source"), F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))).alias("archive_name"))


def store_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with doc_id, damaged files as they are) of stores kept as json (doc_id, content).

    A store that is no json, or has no list of entries, is set aside whole, so that nothing of it is overwritten.
    """
    item = ", ".join(f.replace(" ", ":", 1) for f in ENTRY_FIELDS)
    read = files.withColumn("entries", F.from_json(F.get_json_object("content", "$.entities"), f"array<struct<{item}>>"))
    good = read.where("entries is not null").select("doc_id", F.explode("entries").alias("x")).select("doc_id", "x.*")
    return good, read.where("entries is null").select("doc_id", "content")


#: Fields of an entry in a store's file.
ENTRY_FIELDS = tuple(schemas.ENTITY.split(", "))


def segments_of(parsed: DataFrame) -> DataFrame:
    """One row per segment: path, seg_idx, start_sec, end_sec, text, speaker. Texts without segments give none."""
    s = parsed.select("path", F.posexplode("segments").alias("seg_idx", "s"))
    return s.select("path", F.col("seg_idx").cast("bigint").alias("seg_idx"), F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"), "s.text", "s.speaker")


def folder_plan(files: DataFrame) -> DataFrame:
    """What to import of a folder (path, name): (stem, main, audio).

    Of text files with one stem the richest form stays, the first of equally rich ones; audio of the same stem goes
    with it. Audio without text stands for itself; other endings are left out.
    """
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    f = files.select("path", "name", ext.alias("ext"), F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"))
    rank = F.create_map(*[F.lit(x) for kv in schemas.TEXT_RANK.items() for x in kv])
    texts = f.withColumn("rank", F.try_element_at(rank, F.col("ext"))).where("rank is not null")
    best = texts.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("rank", "path"))).where("n = 1").select("stem", F.col("path").alias("main"))
    audio = f.where(F.col("ext").isin(*schemas.AUDIO)).groupBy("stem").agg(F.max("path").alias("audio"))
    return best.join(audio, "stem", "left").unionByName(audio.join(best, "stem", "leftanti").select("stem", F.col("audio").alias("main"), F.lit(None).cast("string").alias("audio")))


def stored_docs(docs: DataFrame, kind: str) -> DataFrame:
    """Stored documents of one kind, newest name first."""
    return docs.where(F.col("kind") == kind).orderBy(F.desc("name"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """Meeting records of a library folder: one JSON object per file, bad ones kept as nulls with their text."""
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(path)


def locale_table(spark: SparkSession) -> DataFrame:
    """The locale texts as (code, path, value): a fixed, small table."""

    def walk(code: str, at: str, node) -> Iterator[tuple[str, str, str]]:
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                yield from walk(code, path, v)
            else:
                yield code, path, v

    return spark.createDataFrame([r for c, d in schemas.LOCALES.items() for r in walk(c, "", d)], schemas.LOCALE)


class TranscriptSource(DataSource):
    """spark.read.format('transcript').load(folder): segments of every transcript file below the folder."""

    @classmethod
    def name(cls) -> str:
        return "transcript"

    def schema(self) -> str:
        return "path string, seg_idx bigint, start_sec double, end_sec double, text string, speaker string"

    def reader(self, schema) -> DataSourceReader:
        return _TranscriptReader(self.options.get("path", ""))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _TranscriptReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import os

        found = [os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in sorted(fs)]
        return [_File(f) for f in found if os.path.splitext(f)[1].lower() in schemas.TEXT_RANK] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        import os

        with open(partition.path, "rb") as f:
            text, segs, _ = _parse(f.read(), os.path.splitext(partition.path)[1].lower())
        for k, s in enumerate(segs or ([{"start": None, "end": None, "text": text, "speaker": None}] if text else [])):
            yield partition.path, k, s["start"], s["end"], s["text"], s["speaker"]
