"""Recordings to transcripts, participants and glossary."""

from colloquy import connectors
from colloquy.plans import pipelines

from .conftest import rows
from .test_entities import store


def test_transcription(spark):
    chunks = spark.createDataFrame([("r", 0, 30.0, "[00:00] 马克西姆说\n[00:40] 好".encode()), ("r", 1, 30.0, "[00:05] 马克西姆走了\n[00:09] …".encode()), ("r", 2, 60.0, b"")], "recording_id string, idx int, duration double, payload binary")

    def engine(audio, language):
        if not audio:
            raise RuntimeError("quota")
        return audio.decode()

    segs, about = pipelines.transcribed(chunks, engine, replacements=[("马克西姆", "Maxim")])
    assert [(r.start_sec, r.text, r.is_gap) for r in segs.orderBy("seg_idx").collect()] == [(0.0, "Maxim说", False), (29.4, "好", False), (35.0, "Maxim走了", False), (60.0, "(missing)", True)]
    assert rows(about) == [("r", 120.0, 1, 1, 2, "en")]


def test_models_answers_are_checked(spark):
    m = spark.createDataFrame([("a", "x" * 30_000, "2026-01-01"), ("b", "", "2026-01-02")], "meeting_id string, content string, date string")
    assert rows(pipelines.participants(m, lambda p, t: f" Ann,\n {len(p)} " + "z" * 500))[0][1].startswith("Ann, 20000 z")
    s = store(spark, {"name": "Ann"})
    good = "```\n## Names\n- Ann\n## Terms\n```"
    assert pipelines.extracted_glossary("old", s, m, connectors.Scripted({"glossary": good})) == "## Names\n- Ann\n## Terms\n"
    assert pipelines.extracted_glossary("old", s, m, connectors.echo) == "old"
    t = spark.createDataFrame([("1", "Anne said so today"), ("2", "too short"), ("3", None)], "id string, content string")
    assert rows(pipelines.fixed_names(t, lambda p, k: p.replace("Anne", "Ann") if "Anne" in p else "x")) == [("1", "Ann said so today", True), ("2", "too short", False), ("3", None, False)]


def test_keywords_of_all_titles(spark):
    import os
    import re

    import pytest

    from colloquy import registry
    from colloquy.functions import text as T

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")

    def brute(title):
        words = [w for w in re.split(r"""[\s,，。、;；:：?？!！/()（）"“”'‘’\[\]]+""", title) if len(w) >= 2 and w.lower() not in T.STOP_WORDS]
        return " ".join([*words, *(w[i : i + 2] for w in words if re.fullmatch("[㐀-鿿]{4,}", w) for i in range(len(w) - 1))])

    titles = {r.meeting_id: r.title for r in registry.meetings(spark, d).select("meeting_id", "title").collect()}
    got = {r.meeting_id: r.words for r in registry.queries()["keywords"](spark, d).collect()}
    assert got == {k: v if v is None else brute(v) for k, v in titles.items()}
    assert any(re.search("[^A-Za-z ]", x) for x in titles.values() if x)
