"""Import formats: samples and the lines they must give."""

import io
import zipfile

import pytest

from colloquy.functions import text as T
from colloquy.sources import formats as f
from colloquy.sources import readers

from .conftest import rows


def said(got):
    return [(s["start"], s["end"], s["speaker"], s["text"]) for s in got]


def test_captions():
    assert said(f.subtitles("1\n00:00:01,000 --> 00:00:03,000\n王五：预算要走集团流程。\n\n2\nno times\n")) == [(1.0, 3.0, None, "王五：预算要走集团流程。")]
    assert said(f.subtitles("WEBVTT\n\n00:01.000 --> 00:02.500\n<v 林炜>排期下周给。</v>\n")) == [(1.0, 2.5, None, "林炜: 排期下周给。")]
    assert said(f.sbv("0:00:01.000,0:00:03.000\n第一句\n\n0:00:04.500,0:00:06.000\n第二句字幕")) == [(1.0, 3.0, None, "第一句"), (4.5, 6.0, None, "第二句字幕")]
    assert said(f.lrc("[ti:test]\n[00:12.50]第一行\n[01:05.00]第二行")) == [(12.5, 65.0, None, "第一行"), (65.0, None, None, "第二行")]
    assert said(f.lrc("[00:20][00:10]again")) == [(10.0, 20.0, None, "again"), (20.0, None, None, "again")]
    line = "Dialogue: 0,0:00:01.00,0:00:03.00,Default,林炜,0,0,0,,{\\b1}排期\\N下周给, 好"
    assert said(f.ass(line)) == [(1.0, 3.0, "林炜", "排期 下周给, 好")]
    assert not f.looks_like_subtitles("a --> b") and f.looks_like_subtitles("1:00 --> 2:00\n3:00 --> 4:00")


def test_tables():
    got = f.table("speaker,start,text\n张三,00:00:05,数据分散\n李四,12.5,权限没打通\n,,\n", ",")
    assert said(got["segments"]) == [(5.0, None, "张三", "数据分散"), (12.5, None, "李四", "权限没打通")]
    assert said(f.table("start\tend\ttext\n65000\t70000\t第二段\n1.5\t2\tx", "\t")["segments"]) == [(65.0, 70.0, None, "第二段"), (1.5, 2.0, None, "x")]
    assert f.table("a,b\nc,d", ",")["text"] == "a | b\nc | d"
    assert said(f.table("1,2,hello,there\n3,4,x", ",")["segments"]) == [(1.0, 2.0, None, "hello there"), (3.0, 4.0, None, "x")]
    assert f.table('text\n"two\nlines"', ",")["segments"][0]["text"] == "two\nlines"
    for bad in ("", "text\n"):
        with pytest.raises(f.Unreadable):
            f.table(bad, ",")
    assert f.column_of(["Start Time", "TEXT"], f.TEXT_COLUMNS) == 1 and f.column_of(["starting"], f.START_COLUMNS) == 0


def test_json():
    got = f.from_json('{"sentences":[{"speaker_name":"Lin","start_time":1.2,"text":"Hello there"},{"speaker_name":"Zhang","start_time":65.0,"text":"Budget first"}]}')
    assert said(got["segments"]) == [(1.2, None, "Lin", "Hello there"), (65.0, None, "Zhang", "Budget first")]
    assert f.from_json('{"results":{"transcripts":[{"transcript":"all of it"}],"items":[]}}')["text"] == "all of it"
    ms = f.from_json('[{"start":90000,"end":91000,"text":"a"},{"start":3600000,"end":3601000,"text":"b"}]')
    assert [s["start"] for s in ms["segments"]] == [90.0, 3600.0]
    assert f.from_json('[{"start":"0:01","alternatives":[{"transcript":"deep"}],"speaker":{"name":"A"}}]')["segments"][0]["speaker"] == "A"
    words = [{"start": i, "end": i + 1, "text": w} for i, w in enumerate((["so", "it", "goes", "."] * 12))]
    import json

    merged = f.from_json(json.dumps(words))["segments"]
    assert len(merged) == 12 and merged[0]["text"] == "so it goes." and merged[0]["end"] == 4.0
    for bad in ("{", "[]", '{"x": 1}'):
        with pytest.raises(f.Unreadable):
            f.from_json(bad)


def _zip(name, xml):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(name, xml)
    return b.getvalue()


def test_documents():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    assert f.docx(_zip("word/document.xml", f"<w:d {w}><w:p><w:t>A</w:t><w:tab/><w:t>B</w:t></w:p><w:p><w:t>C</w:t><w:br/></w:p></w:d>")) == "A\tB\nC"
    t = 'xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    assert f.odt(_zip("content.xml", f'<d {t}><text:h>T</text:h><text:p>a<text:s text:c="2"/>b<text:tab/>c</text:p></d>')) == "T\na  b\tc"
    for reader in (f.docx, f.odt):
        with pytest.raises(f.Unreadable):
            reader(b"no zip")
    assert f.html_text("<head><title>x</title></head><h1>纪要</h1><p>第一段&amp;内容</p><script>x=1</script><td>a</td><td>b</td>") == "纪要\n\n第一段&内容\na b"
    rtf = r"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0  world\par " + "\\" + r"u20250? next\'e9}"
    assert f.rtf(rtf) == "Hello bold world\n会 nexté"
    mail = b"Subject: =?utf-8?b?6aKE566X?=\r\nFrom: a@b.test\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    assert f.eml(mail) == "From: a@b.test\nSubject: 预算\n\nbody"


def test_decoding_and_routing():
    s = "老王：这个季度回款有问题"
    assert f.decode(s.encode("gb18030")) == s and f.decode("﻿x".encode()) == "x" and f.decode("é".encode("utf-16")) == "é"
    assert f.imported("00:01 --> 00:02\na\n\n00:03 --> 00:04\nb", ".txt")["segments"][1]["text"] == "b"
    assert f.imported("[not json", ".md") == {"segments": [], "text": "[not json"}
    assert f.format_of('{"text": "a"}') == "json" and f.format_of("WEBVTT\n\n00:01 --> 00:02\na\n\n00:02 --> 00:03\nb") == "vtt" and f.format_of("hi") == "text"
    with pytest.raises(f.Unreadable):
        f.imported(" \n", ".txt")


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:03,000\nhello\n", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("老王来了".encode("gb18030"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(b"\0")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.srt", "b.txt", "c.docx"}
    assert got["a.srt"].segments[0].text == "hello" and got["b.txt"].text == "老王来了" and got["c.docx"].error
    assert rows(readers.segments_of(readers.read_files(spark, str(tmp_path))).select("seg_idx", "start_sec", "text")) == [(0, 1.0, "hello")]
    spark.dataSource.register(readers.TranscriptSource)
    source = spark.read.format("transcript").load(str(tmp_path))
    assert sorted(r.text for r in source.collect()) == ["hello", "老王来了"]


def test_pasted_and_plan(spark):
    p = spark.createDataFrame([("1", "  "), ("2", '[{"text":"a","start":1}]'), ("3", "plain"), ("4", None)], "path string, content string")
    assert rows(readers.read_pasted(p).select("path", "format", "text")) == [("2", "json", "a"), ("3", "paste", "plain")]
    names = ["rec1.srt", "rec1.txt", "rec1.m4a", "复盘.docx", "复盘.txt", "solo.mp3", "x.exe"]
    plan = readers.folder_plan(spark.createDataFrame([(n, n) for n in names], "path string, name string"))
    assert rows(plan) == [("rec1", "rec1.srt", "rec1.m4a"), ("solo", "solo.mp3", None), ("复盘", "复盘.txt", None)]


def test_text_primitives(spark):
    df = spark.createDataFrame(
        [("<v.loud 林炜>排期</v> <c>a</c>{\\i1}", "Lin Wei（客户）/A", "minutes-1355", 3725.9, "0:01:02,5")], "tags string, name string, stem string, s double, ts string"
    )
    from colloquy.operators import export
    from pyspark.sql import functions as F

    r = df.select(
        T.clean_tags(F.col("tags")).alias("a"), T.norm_name(F.col("name")).alias("b"), T.slug(F.col("name")).alias("c"), export.report_label(F.col("stem")).alias("d"),
        T.stamp(F.col("s")).alias("e"), T.cue_stamp(F.col("s")).alias("f"), T.seconds_of(F.col("ts")).alias("g"), T.file_slug(F.lit(" a/b: c..d. ")).alias("h"), T.file_slug(F.lit("..")).alias("i"),
        T.mention_count(F.lit("out of ignorance nora asked nora."), F.lit("Nora")).alias("j"), T.mention_count(F.lit("我们找王明，王明说"), F.lit("王明")).alias("k"),
        T.week_label(F.to_date(F.lit("2026-08-19"))).alias("l"), T.week_start(F.to_date(F.lit("2026-08-19"))).cast("string").alias("m"), T.language_mix(F.lit("我们今天讨论 GEO")).alias("n"),
        T.language_mix(F.lit("hello there")).alias("o"), T.status_of(F.lit("x 状态：已完成。")).alias("p"), T.refs(F.lit("a [2026-01-02-x] [[no]] [12:30 z] [zzzz]")).alias("q"),
        T.date_prefix(F.lit("8/20 done"), F.lit("2026")).alias("r"), T.strip_fence(F.lit("```md\na\n```")).alias("s"), T.json_object(F.lit('so: {"a": 1} ok')).alias("t"),
        T.drop_title(F.lit("# Brief · x"), F.lit("# Brief of today\n\ntext")).alias("u"), T.keywords(F.lit("what 长期记忆 budget budget")).alias("v"), T.locale_code(F.lit("zh_CN.UTF-8")).alias("w"),
        T.without_thoughts(F.lit("a<think>b</think>c<think>d")).alias("x"), T.snippet(F.lit("x" * 100 + "key" + "y" * 100), F.lit("key")).alias("y"), T.answer_budget(F.lit(9000)).alias("z"),
        T.after_heading(F.lit("# t\n- a\n## Transcript\n[00:01] hello")).alias("aa"), T.source_label(F.lit("watch:box"), {"watch": "Folder"}).alias("bb"),
    ).first()
    assert r.a == "林炜: 排期 a" and r.b == "linwei客户/a" and r.c == "lin-wei-客户-a" and r.d == "Minutes 13:55"
    assert (r.e, r.f, r.g, r.h, r.i) == ("1:02:05", "01:02:05,900", 62.5, "a-b-c-d", "untitled")
    assert (r.j, r.k, r.l, r.m, r.n, r.o, r.p, r.q) == (2, 2, "2026-W34", "2026-08-17", "zh", "en", "done", ["2026-01-02-x"])
    assert (r.r, r.s, r.t, r.u) == ("2026-08-20", "a", '{"a": 1}', "text")
    assert r.v == ["长期记忆", "budget", "budget", "长期", "期记", "记忆"] and r.w == "zh-CN" and r.x == "ac"
    assert r.y.startswith("…") and r.y.endswith("…") and "key" in r.y and r.z == 250 and r.aa == "hello" and r.bb == "Folder box"
