"""Streams and incremental work: recording chunks, watched folders, day and week buckets, work done once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import runtime

CHECKED = "rec_id string, seq bigint, status string, bytes bigint, total bigint"


class SequenceGuard(StatefulProcessor):
    """Accepts the chunks of a recording in order: an earlier number is a duplicate, a later one a gap.

    The state of a recording is its next number and its size. Rows of one batch are put in order first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("next", "seq bigint, total bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        nxt, total = self.state.get() if self.state.exists() else (0, 0)
        batch = pd.concat(rows).sort_values("seq", kind="stable")
        out = []
        for seq, payload in zip(batch.seq, batch.payload, strict=True):
            size = len(payload) if payload is not None else 0
            status = "dup" if seq < nxt else "gap" if seq > nxt else "ok"
            if status == "ok":
                nxt, total = nxt + 1, total + size
            out.append((key[0], int(seq), status, size, total))
        self.state.update((nxt, total))
        yield pd.DataFrame(out, columns=["rec_id", "seq", "status", "bytes", "total"])

    def close(self) -> None:
        pass


def guarded(chunks: DataFrame) -> DataFrame:
    """A stream of chunks (rec_id, seq, payload) with what becomes of each. Needs the RocksDB state store."""
    runtime.ship(chunks.sparkSession)
    return chunks.groupBy("rec_id").transformWithStateInPandas(SequenceGuard(), outputStructType=CHECKED, outputMode="Append", timeMode="None")


def guarded_batch(chunks: DataFrame) -> DataFrame:
    """The same for chunks already there, in the order they came (n): (rec_id, n, seq, status).

    What becomes of a chunk depends on all before it: recordings are streams over sorted partitions, of which only the
    next number is kept. A recording, one row for every few seconds of sound, lies in one partition.
    """

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, nxt = None, 0
        for p in parts:
            states = []
            for rec, seq in zip(p.rec_id, p.seq, strict=True):
                if rec != now:
                    now, nxt = rec, 0
                states.append("dup" if seq < nxt else "gap" if seq > nxt else "ok")
                nxt += seq == nxt
            yield p.assign(status=states)

    runtime.ship(chunks.sparkSession)
    rows = chunks.select("rec_id", "n", "seq").repartition("rec_id").sortWithinPartitions("rec_id", "n")
    return rows.mapInPandas(check, "rec_id string, n bigint, seq bigint, status string")


def without_duplicates(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream in which retried chunks come once."""
    return chunks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rec_id", "seq"])


def idle_recordings(chunks: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """Stretches of a recording that ended because nothing came for a while: (rec_id, start, end, chunks)."""
    timed = chunks.withWatermark("ts", late) if chunks.isStreaming else chunks
    return timed.groupBy("rec_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("chunks")).select("rec_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chunks")


def per_period(events: DataFrame, ts: str, period: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Events of each day or week ('1 day', '1 week' from Monday) and key."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    start = {"1 week": "4 days"}.get(period)  # weeks are counted from a Thursday
    w = F.window(ts, period, period, start) if start else F.window(ts, period)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


class Ledger:
    """Keys of work that was done, in a folder; each batch adds its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def done(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], "key string")
        return self.spark.read.schema("key string").parquet(self.folder)

    def add(self, keys: DataFrame) -> None:
        keys.select(F.col("key").cast("string").alias("key")).distinct().join(self.done(), "key", "leftanti").write.mode("append").parquet(self.folder)


def once(stream: DataFrame, key: str, ledger: Ledger, work: Callable[[DataFrame], None], checkpoint: str, snapshot_first: bool = False):
    """Do ``work`` with each row once, whatever batches it comes in, and over restarts.

    With ``snapshot_first`` what is there when the ledger is still empty counts as seen, as a watched folder's files.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.withColumn("key", F.col(key).cast("string"))
        if snapshot_first and n == 0 and ledger.done().isEmpty():
            ledger.add(rows.select("key"))
            return
        fresh = runtime.cut(rows.join(ledger.done(), "key", "leftanti").dropDuplicates(["key"]))
        if not fresh.isEmpty():
            work(fresh.drop("key"))
            ledger.add(fresh.select("key"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files of a folder: path, size, time, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)


def stable(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose size did not change between two looks."""
    return now.join(before.select("path", F.col("length").alias("was")), "path").where("length = was and length > 0").drop("was")


def message(event: Column, data: Column) -> Column:
    """A server-sent message: the event's name, its data as one line of json, and the blank line that ends it."""
    return F.concat(F.lit("event: "), F.regexp_replace(event, r"\s", " "), F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def pushed(stream: DataFrame, event: str, send: Callable[[str], None], checkpoint: str):
    """Send every row of a stream (of progress, not of data) as a message, batch by batch in the order of its columns."""

    def batch(df: DataFrame, n: int) -> None:
        for r in df.select(message(F.col(event), F.struct(*df.columns)).alias("m")).orderBy("m").toLocalIterator():
            send(r.m)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sent(chunks: Iterable[tuple[int, bytes]], post: Callable[[int, bytes], int], attempts: int = 6, wait: Callable[[float], None] = time.sleep) -> int:
    """Send a recording's chunks in order; how many arrived.

    A chunk is tried again after one second, then two and so on; a conflict (409, the receiver expects another number)
    ends the sending, as does a chunk that fails every time.
    """
    done = 0
    for seq, payload in chunks:
        for k in range(1, attempts + 1):
            code = post(seq, payload)
            if code == 409:
                return done
            if 200 <= code < 300:
                break
            if k == attempts:
                return done
            wait(float(k))
        done += 1
    return done


def to_resume(meetings: DataFrame, transcripts: DataFrame, audio: DataFrame, least: int = 1024) -> DataFrame:
    """(meeting_id, status) of transcriptions to take up again after a restart.

    New and interrupted ones with audio and no transcript; recordings cut off are new if enough of them arrived.
    """
    m = meetings.join(audio.select("meeting_id", "bytes"), "meeting_id").join(transcripts.select("meeting_id"), "meeting_id", "leftanti")
    cut_off = (F.col("status") == "recording") & (F.col("bytes") >= least)
    return m.where(F.col("status").isin("new", "transcribing") | cut_off).select("meeting_id", F.when(cut_off, "new").otherwise(F.col("status")).alias("status"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows delivered more than once the last, in a batch."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


