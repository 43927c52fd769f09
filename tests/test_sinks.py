"""Transcripts in every form, filed documents, edited meetings, damaged stores."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import entities, export, library, sequence
from colloquy.sources import readers

from .conftest import rows
from .test_entities import store

SEGS = "meeting_id string, seg_idx bigint, start_sec double, end_sec double, text string, speaker string"
MEET = "meeting_id string, title string, date string, duration string, source string, participants string"


def given(spark):
    s = [("a", 0, 1.0, None, "hello", "Ann"), ("a", 1, 61.5, float("nan"), 'say "x"\nagain', None), ("a", 2, None, None, "", "Bob"), ("a", 3, None, None, None, None), ("b", 5, None, None, "no times", ""), ("c", 0, 1.0, 2.0, " ", None)]
    m = [("a", "A", "2026-01-02", "09:99", "paste", ""), ("b", "B", "2026-01-03", None, "paste", "Ann"), ("d", "D", "", "", "", "")]
    return spark.createDataFrame(m, MEET), spark.createDataFrame(s, SEGS)


def text(df, meeting):
    return [r.line for r in df.where(F.col("meeting_id") == meeting).orderBy("part", "n").collect()]


def test_rendered(spark):
    m, s = given(spark)
    assert text(export.rendered(m, s, "txt"), "a") == ["Ann: hello", 'say "x"\nagain'] and text(export.rendered(m, s, "txt"), "b") == ["no times"]
    assert text(export.rendered(m, s, "vtt"), "a") == ["WEBVTT\n", "00:00:01.000 --> 00:01:01.500\nAnn: hello\n", '00:01:01.500 --> 00:01:06.500\nsay "x"\nagain\n']
    assert text(export.rendered(m, s, "srt"), "a")[0] == "1\n00:00:01,000 --> 00:01:01,500\nAnn: hello\n" and text(export.rendered(m, s, "srt"), "b") == []
    md = text(export.rendered(m, s, "md"), "b")
    assert md[0] == "# B" and md[-1] == "no times" and not any(x.startswith("- Duration") for x in md) and text(export.rendered(m, s, "md"), "d") == []
    twin = json.loads("\n".join(text(export.rendered(m, s, "json"), "a")))
    assert twin == {"segments": [{"start": 1.0, "text": "hello", "speaker": "Ann"}, {"start": 61.5, "text": 'say "x"\nagain'}]}
    assert json.loads("".join(text(export.rendered(m, s, "json"), "b"))) == {"segments": [{"text": "no times"}]}
    for form in export.FORMS:
        assert export.rendered(m, s.limit(0), form).count() == 0
    with pytest.raises(ValueError):
        export.rendered(m, s, "pdf")


def test_written(spark):
    m, s = given(spark)
    md, twin, meta = export.written(m, s)
    assert rows(meta) == [("a", "", "done"), ("b", "", "done"), ("c", "00:02", "done")]
    timed = s.withColumn("end_sec", F.lit(3725.0))
    md, twin, meta = export.written(m, timed)
    assert "- Duration: 1:02:05" in text(md, "a") and {r.duration for r in meta.collect()} == {"1:02:05"} and text(twin, "b")[0] == '{"segments": ['


def test_filed_and_edited(spark):
    doc = "kind string, name string, content string, late int"
    old = spark.createDataFrame([("brief", "2026-01-02", "old", 9), ("report", "minutes-1355", "1", 9), ("report", "minutes-1355-2", "2", 9)], doc)
    new = spark.createDataFrame([("brief", "2026-01-02", "new", 9), ("brief", "2026-01-03", None, 9), ("report", "minutes-1355", "3", 9), ("prep", "minutes-1355", "4", 9)], doc)
    assert rows(library.filed(old, new)) == [("brief", "2026-01-02", "new"), ("brief", "2026-01-03", None), ("prep", "minutes-1355", "4"), ("report", "minutes-1355", "1"), ("report", "minutes-1355-2", "2"), ("report", "minutes-1355-3", "3")]
    assert library.filed(old.limit(0), new.limit(0)).count() == 0 and library.filed(old, new.limit(0)).count() == 3
    m, _ = given(spark)
    c = spark.createDataFrame([("a", "  New \n title ", "2026-02-30", None), ("b", " ", "2026-02-28", " Ann,  Bob "), ("x", "ghost", None, None)], "meeting_id string, title string, date string, participants string")
    got = {r.meeting_id: (r.title, r.date, r.participants) for r in library.edited(m, c).collect()}
    assert got == {"a": ("New title", "2026-01-02", ""), "b": ("B", "2026-02-28", "Ann, Bob"), "d": ("D", "", "")}


def test_damaged_stores_are_set_aside(spark):
    good = {"entities": [{"id": "p-1", "type": "person", "name": "Ann", "aliases": ["A"], "facts": [{"text": "x", "date": "", "source": "m"}], "ord": 3}]}
    files = spark.createDataFrame([("1", json.dumps(good)), ("2", '{"entities": [{"id"'), ("3", ""), ("4", None), ("5", '{"other": 1}'), ("6", '{"entities": []}')], "doc_id string, content string")
    entries, damaged = readers.store_files(files)
    assert [(r.doc_id, r.id, r.aliases, r.facts[0].source, r.ord) for r in entries.collect()] == [("1", "p-1", ["A"], "m", 3)]
    assert [r.doc_id for r in damaged.orderBy("doc_id").collect()] == ["2", "3", "4", "5"]
    names = spark.createDataFrame([("/a/Talk.SRT",), ("b",)], "path string")
    assert rows(readers.archived(names)) == [("/a/Talk.SRT", "source.srt"), ("b", "source")]


def test_pages_and_clearing(spark, tmp_path):
    s = store(spark, {"id": "a", "name": "Ann", "facts": [("f1", "2026-02-01", "m1"), ("f2", "", "")], "sources": ["m1", "gone"]}, {"id": "b", "name": "B"}, {"id": "c", "type": "commitment", "name": "x", "status": "open"})
    m = spark.createDataFrame([("m1", "Talk", "t")], "meeting_id string, title string, md_text string")
    page = {r.id: r for r in entities.detail(s, m).collect()}
    assert [(f.text, f.source_title) for f in page["a"].facts] == [("f1", "Talk"), ("f2", "")] and [(x.source, x.exists_flag) for x in page["a"].sources] == [("gone", False), ("m1", True)]
    assert page["b"].facts == [] and page["b"].sources == []
    g = spark.createDataFrame([("names", "x")], "section string, term string")
    assert tuple(library.dashboard(library.with_transcript(m, m), s, g).first()) == (1, 2, 0, 1, 1, 0, 1, "Ann, B")
    assert tuple(library.dashboard(m.limit(0), s.limit(0), g.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0, "")
    v = export.Versions(spark, str(tmp_path / "s"))
    first = v.write(s)
    v.clear()
    assert v.read().count() == 0 and v.read(first).count() == 3
    lines = spark.createDataFrame([("d", 0, "[00:01] a"), ("d", 1, "…"), ("d", 2, ""), ("e", 0, "Thanks for watching!")], "doc_id string, line_no int, line string")
    assert rows(sequence.clean_preview(lines)) == [("d", 3, 2), ("e", 1, 0)]
    once = sequence.clean_lines(lines)
    assert rows(sequence.clean_lines(once)) == rows(once)  # cleaning again changes nothing
