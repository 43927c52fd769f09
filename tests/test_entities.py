"""The entity store, its Markdown, the glossary, and the versioned table."""

import pytest
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.operators import entities as E
from colloquy.operators import export, glossary, graph, library, markdown

from .conftest import rows

FIELDS = [f.split()[0] for f in schemas.ENTITY.split(", ")]


def store(spark, *given):
    out = []
    for k, e in enumerate(given):
        full = {"id": f"x-{k}", "type": "person", "name": "", "aliases": [], "summary": "", "facts": [], "sources": [], "status": "", "owner": "", "due": "", "created": "c", "updated": f"u{k}", "ord": k} | e
        out.append(tuple(full[f] for f in FIELDS))
    return spark.createDataFrame(out, schemas.ENTITY)


MD = """# memory

## 人物

- **林炜（LW，转写亦作「林伟」）**：产品负责人 [2026-01-02-周会]
  - 8/20 排期下周给
    还有预算 [2026-01-03-例会]
- **Nora Berg (Acme, sales lead of the north)**: sells

## Commitments & decisions
- **张三 承诺（8/20 周会）**：给报价 状态：已完成
"""


def test_markdown_to_entries(spark):
    read = lambda *texts: markdown.from_markdown(spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "doc_id string, content string"), "2026-05-01T00:00:00").orderBy("doc_id", "ord").collect()
    a, b, c = read(MD)
    assert a.name == "林炜" and a.aliases == ["LW", "林伟"] and a.summary == "产品负责人"
    assert [tuple(f) for f in a.facts] == [("8/20 排期下周给 还有预算", "2026-08-20", "2026-01-02-周会")]
    assert b.name == "Nora Berg" and b.aliases == [] and b.summary.startswith("（Acme, sales lead")
    assert (c.type, c.name, c.status, c.owner) == ("commitment", "张三 承诺（8/20 周会）", "done", "张三")
    again = read("## People\n- **A**: one\n- **a.**: a longer one [2026-02-02-x]\n", "## Nothing\n- **A**: x\n## Terms\n\nlost\n<!-- - no -->\n* KPI: figure\n  [2026-03-01-y]\n  goes on\n  - 1/2 told [brief-z]\n")
    assert [(r.doc_id, r.name) for r in again] == [("0", "A"), ("1", "KPI")]
    assert again[0].summary == "a longer one" and [tuple(f) for f in again[0].facts] == [("one", "2026-02-02", "2026-02-02-x")]
    assert again[1].sources == ["2026-03-01-y", "brief-z"] and [tuple(f) for f in again[1].facts] == [("goes on", "2026-03-01", "2026-03-01-y"), ("1/2 told", "2026-01-02", "brief-z")]
    twins = read("## Terms\n- **A b**\n- **A_b c**\n- **A-b**: x\n- **a**\n- **B（also c、d）**\n")
    assert [(r.id, r.name, r.aliases) for r in twins] == [("t-a-b", "A b", []), ("t-a_b-c", "A_b c", []), ("t-a", "a", []), ("t-b", "B", ["c", "d"])]
    df = spark.createDataFrame([("d", MD), ("e", None), ("f", "")], "doc_id string, content string")
    assert markdown.from_markdown(df, "2026").count() == 3
    heads = spark.createDataFrame([(["## 人物", "## x"],), (["## People"],), ([],)], "h array<string>")
    assert [r[0] for r in heads.select(markdown.heading_language(F.col("h"))).collect()] == ["zh-CN", "en", None]


def test_search_and_relevance(spark):
    s = store(
        spark,
        {"id": "p1", "name": "Nora Berg", "aliases": ["NB"], "summary": "runs budget"},
        {"id": "p2", "name": "Budget Person", "updated": "z"},
        {"id": "p3", "name": "Other", "facts": [("x", "", ""), ("the BUDGET " + "y" * 200, "", "")]},
        {"id": "c1", "type": "commitment", "name": "send it", "owner": "nora berg", "status": "open"},
        {"id": "c2", "type": "commitment", "name": "kept", "owner": "Nora Berg", "status": "done"},
        {"id": "e", "name": "", "aliases": []},
    )
    assert [(r.id, r.where) for r in E.search(s, " Budget ").collect()] == [("p2", "name"), ("p1", "summary"), ("p3", "fact")]
    assert E.search(s, " ").count() == 0
    assert [(r.id, r.score) for r in E.relevant(s, "Ask Nora Berg, not ignoranora bergs").collect()] == [("p1", 1), ("c1", 1)]
    docs = spark.createDataFrame([(1, "nora berg and Nora Berg; budget person"), (2, None), (3, "")], "doc_id int, content string")
    assert rows(E.mentions(s, docs)) == [(1, "p1", 2), (1, "p2", 1)]
    han = store(spark, {"id": "z", "name": "王明"}, {"id": "ai", "type": "term", "name": "AI"}, {"id": "no", "type": "term", "name": "IT"})
    assert rows(E.mentions(han, spark.createDataFrame([(1, "我找王明，王明不在 AI it")], "doc_id int, content string"))) == [(1, "ai", 1), (1, "z", 2)]
    assert rows(E.counts(s)) == [(4, 0, 2, 0, 1)]
    found = E.find_by_name(s, spark.createDataFrame([("person", "nora-berg"), ("person", "?"), ("term", "Nora Berg")], "type string, name string"))
    assert rows(found) == [("person", "?", None), ("person", "nora-berg", "p1"), ("term", "Nora Berg", None)]
    like = E.closest_commitment(s, spark.createDataFrame([("send it!!",), ("nothing alike",)], "name string"))
    assert [(r.name, r.id) for r in like.collect()] == [("send it!!", "c1")]
    assert E.mentions(s.limit(0), docs).count() == 0 and E.search(s.limit(0), "x").count() == 0


def test_mentions_by_automata_and_by_pieces(spark):
    import random

    rng = random.Random(4)
    words = ["ann", "anna", "ann b", "ai", "王明", "明", "c3", "nora-berg", "ann.b", "o'neil", "é", "über"]
    s = store(spark, *[{"id": f"n{i}", "name": w.upper(), "aliases": [rng.choice(words)]} for i, w in enumerate(words)])
    texts = [(i, "".join(rng.choice([*words, " ", "-", "x", "，"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    df = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id int, content string")
    assert rows(E.mentions(s, df)) == rows(E.mentions(s, df, most_passes=0)) != []


def test_tidying_asks_from_the_partitions(spark):
    from colloquy.plans import analyses

    import json

    many = [(f"fact {k}", "", "") for k in range(12)]
    s = store(spark, {"id": "a", "name": "A", "facts": many}, {"id": "b", "name": "B", "facts": many}, {"id": "c", "name": "C"})

    def model(prompt, task):
        return json.dumps({"entities": [{"id": e["id"], "summary": "", "facts": e["facts"][: 6 if e["id"] == "a" else 1]} for e in json.loads(prompt)] + [{"id": "c", "facts": []}]})

    meetings = spark.createDataFrame([], "meeting_id string, content string")
    got = {r.id: len(r.facts) for r in analyses.Analyses(spark, meetings, s, None, model).tidy("now").collect()}
    assert got == {"a": 6, "b": 12, "c": 0}


def test_upsert_sees_what_came_before(spark):
    s = store(spark, {"id": "p-lin", "name": "林炜", "aliases": ["林伟"], "facts": [("排期下周给", "", "")]}, {"id": "c-quote", "type": "commitment", "name": "send the revised quote", "status": "open"})
    batch = [
        ("person", "林伟", ["LW"], "", [("排期下周给。", "", ""), ("new fact", "2026-01-01", "m1")], "", "", "", 0),
        ("person", "LW", [], "head of product", [], "", "", "", 1),
        ("commitment", "send the revised quotes", [], "", [], "DONE", "Ann", "", 2),
        ("term", "KPI", [], "", [], "", "", "", 3),
        ("term", "KPI", ["key figure"], "", [], "", "", "", 4),
        ("bad", "x", [], "", [], "", "", "", 5),
        ("term", " ", [], "", [], "", "", "", 6),
    ]
    got = {r.id: r for r in E.upserted(s, spark.createDataFrame(batch, E.ITEM), "now").collect()}
    assert set(got) == {"p-lin", "c-quote", "t-kpi"}
    lin = got["p-lin"]
    assert lin.aliases == ["林伟", "LW"] and [f.text for f in lin.facts] == ["排期下周给", "new fact"] and lin.summary == "head of product" and lin.sources == ["m1"]
    assert (got["c-quote"].status, got["c-quote"].owner) == ("done", "Ann") and got["t-kpi"].aliases == ["key figure"]
    assert E.upserted(s, spark.createDataFrame([], E.ITEM), "now").count() == 2


def test_closest_commitment_compares_few(spark, monkeypatch):
    import difflib
    import random

    rng = random.Random(5)
    words = "send the revised quote plan report to client team before friday monday after review".split()
    texts = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 10))) for _ in range(150)))
    texts += texts[:30]  # copies: the first stands for all
    asked = [f"Please: {x}" for x in texts[:40]] + [x[: len(x) // 2] + " now" for x in texts[40:60]] + ["zzz qqq xxx"]

    def brute(name):
        found = [(difflib.SequenceMatcher(None, E.norm(name), E.norm(x)).ratio(), -i) for i, x in enumerate(texts)]
        r, i = max(found)
        return (name, f"c{-i}", r) if r >= E.SAME_COMMITMENT else None

    want = sorted(x for x in map(brute, asked) if x)
    monkeypatch.setattr(E, "WANTED_BLOCK", 20)
    monkeypatch.setattr(E, "STORE_BLOCK", 40)
    s = store(spark, *[{"id": f"c{i}", "type": "commitment", "name": x} for i, x in enumerate(texts)])
    assert rows(E.closest_commitment(s, spark.createDataFrame([(x,) for x in asked], "name string"))) == want
    compared = []
    real = difflib.SequenceMatcher
    monkeypatch.setattr(E.difflib, "SequenceMatcher", lambda *x: compared.append(x) or real(*x))
    w = E.Wordings([E.norm(x) for x in texts])
    assert all(w.closest(E.norm(x), list(range(len(texts)))) for x in asked[:40]) and len(compared) < 40 * 10


def test_likeness_is_that_of_difflib():
    import difflib
    import random

    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd 王") for _ in range(rng.choice((0, 3, 8, 30, 210)))) for _ in "ab")
        b = rng.choice((a, a[1:] + b[:2], b))
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert E.likeness(a, b, 0.72) == r if r >= 0.72 else E.likeness(a, b, 0.72) < 0.72


def test_upsert_compares_only_what_no_name_matches(spark, monkeypatch):
    seen, real = [], E.closest_commitment
    monkeypatch.setattr(E, "closest_commitment", lambda e, w: seen.extend(r.name for r in w.collect()) or real(e, w))
    s = store(spark, {"id": "c1", "type": "commitment", "name": "send the revised quote"}, {"id": "c2", "type": "commitment", "name": "book a room"})
    items = [("commitment", x, [], "", [], "done", "", "", n) for n, x in enumerate(("Send the revised quote!", "book a room", "send the revised quotes"))]
    got = E.upserted(s, spark.createDataFrame(items, E.ITEM), "now").collect()
    assert sorted((r.id, r.status) for r in got) == [("c1", "done"), ("c2", "done")] and seen == ["send the revised quotes"]


def test_upsert_sends_no_side_of_a_join_to_the_driver(spark, monkeypatch):
    plans = []
    for name in ("cut", "stored"):
        def spied(df, *args, made=getattr(E.runtime, name)):
            out = made(df, *args)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(E.runtime, name, spied)
    s = store(spark, {"id": "c1", "type": "commitment", "name": "send the revised quote"}, {"id": "p", "name": "Ann"}, {"id": "q", "name": "Bea"})
    items = [("commitment", "send the revised quotes", [], "", [], "done", "", "", 1), ("person", "ANN", ["Annie"], "", [], "", "", "", 2)]
    got = E.upserted(s, spark.createDataFrame(items, E.ITEM), "now")
    assert rows(got.select("id", "status", "updated")) == [("c1", "done", "now"), ("p", "", "now"), ("q", "", "u2")]
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, real = [], graph.runtime.cut
    monkeypatch.setattr(graph.runtime, "cut", lambda df: rounds.append(1) or real(df))
    # two rising chains that meet where their labels are greatest, a star, and a loop
    edges = [(i, i + 2) for i in range(100, 180)] + [(180, 181)] + [(300, i) for i in range(290, 299)] + [(400, 401), (401, 402), (402, 400), (500, 500)]
    want = {x: 100 for x in range(100, 182)} | {x: 290 for x in (*range(290, 299), 300)} | {400: 400, 401: 400, 402: 400, 500: 500}
    assert dict(rows(graph.components(spark.createDataFrame([(f"{a}", f"{b}") for a, b in edges], "a string, b string")))) == {f"{k}": f"{v}" for k, v in want.items()}
    assert len(rounds) <= 11


def test_changes(spark):
    s = store(
        spark,
        {"id": "a", "name": "Ann", "summary": "short", "facts": [("f1", "2026-02-01", "s1")], "sources": ["s1"]},
        {"id": "b", "name": "Ann B.", "aliases": ["AB"], "summary": "the long summary", "facts": [("f2", "2026-01-01", "s2"), ("f0", "", "")]},
        {"id": "c", "type": "commitment", "name": "x", "status": "open"},
    )
    change = spark.createDataFrame([("c", "done", None), ("a", "done", "  new  ")], "id string, status string, summary string")
    got = {r.id: r for r in E.updated(s, change, "now").collect()}
    assert got["c"].status == "done" and got["a"].status == "" and got["a"].summary == "new" and got["b"].updated == "u1"
    merged = {r.id: r for r in E.folded_into(s, spark.createDataFrame([("a", "b")], "id string, into string"), "now").collect()}
    assert set(merged) == {"b", "c"} and merged["b"].aliases == ["AB", "Ann"] and [f.text for f in merged["b"].facts] == ["f0", "short", "f2", "f1"]
    assert merged["b"].sources == ["s1", "s2"]
    assert [r.id for r in E.removed(s, spark.createDataFrame([("a",)], "id string")).orderBy("id").collect()] == ["b", "c"]
    twice = store(spark, {"id": "1", "name": "A-1", "summary": "xx"}, {"id": "2", "name": "a 1", "summary": "longer"}, {"id": "3", "name": "a1", "summary": "x"})
    one = E.deduplicated(twice).collect()
    assert len(one) == 1 and one[0].id == "1" and one[0].summary == "longer" and [f.text for f in one[0].facts] == ["xx", "x"]
    new = store(spark, {"id": "n", "name": "ANN", "summary": "short", "facts": [("f1", "2026-02-01", "s1")], "updated": "later"})
    kept = E.kept_identity(s, new).first()
    assert (kept.id, kept.updated) == ("a", "u0")
    guard = spark.createDataFrame([(list("abcdefg"), list("a")), (list("abc"), [])], "o array<string>, n array<string>")
    assert [r[0] for r in guard.select(E.tidied(F.col("o"), F.col("n"))).collect()] == [False, True]


GLOSSARY = """# 词表
<!-- - not me -->
## 人名
- Lin Wei (product lead)
- **Maxim**（误写：马克西姆、马克）｜the boss
- * rule: a very long explanatory sentence that is certainly more than forty characters
## Terms
* Release Plan (misheard: 发布计划, release plant) | term
"""


def test_glossary(spark):
    g = glossary.parsed(spark.createDataFrame([("g", GLOSSARY)], "doc_id string, content string"))
    assert rows(g.select("section", "term", "wrong", "note")) == [("names", "Lin Wei", [], "product lead"), ("names", "Maxim", ["马克西姆", "马克"], "the boss"), ("terms", "Release Plan", ["发布计划", "release plant"], "term")]
    reps = [tuple(r) for r in glossary.safe_replacements(g).collect()]
    assert reps == [("马克西姆", "Maxim")]
    t = spark.createDataFrame([("1", "马克西姆说汤不够"), ("2", ""), ("3", None)], "doc_id string, content string")
    assert [(r.content, r.n) for r in glossary.corrected(t, reps).orderBy("doc_id").collect()] == [("Maxim说汤不够", 1), ("", 0), (None, None)]
    assert [r.term for r in glossary.prompt_terms(g).collect()] == ["Release Plan", "Maxim", "Lin Wei"]
    assert rows(glossary.hits(g, t).select("doc_id", "term")) == [("1", "Maxim")]
    assert rows(glossary.counts(g)) == [("names", 2), ("terms", 1)]
    ok = spark.createDataFrame([("x", "## Names\n- a\n## Terms\n"), ("x" * 2000, "## Names\n## Terms\n"), ("x", "## Names\n")], "o string, n string")
    assert [r[0] for r in ok.select(glossary.rewrite_allowed(F.col("o"), F.col("n"))).collect()] == [True, False, False]
    fix = spark.createDataFrame([("abcdefghij", "abcdefghik"), ("abcdefghij", "abc"), (" ", " ")], "o string, n string")
    assert [r[0] for r in fix.select(glossary.name_fix_allowed(F.col("o"), F.col("n"))).collect()] == [True, False, False]


def test_rendering(spark):
    s = spark.createDataFrame([("m", 0, 1.0, None, "hello", "Ann"), ("m", 1, 3661.5, 3662.0, "Ann: again", "ann"), ("m", 2, None, None, "", None)], "meeting_id string, seg_idx int, start_sec double, end_sec double, text string, speaker string")
    assert [r.line for r in export.transcript_lines(s).orderBy("seg_idx").collect()] == ["[00:01] Ann: hello", "[1:01:01] Ann: again"]
    assert [r.cue for r in export.cues(s).orderBy("seg_idx").collect()] == ["1\n00:00:01,000 --> 01:01:01,500\nAnn: hello", "2\n01:01:01,500 --> 01:01:02,000\nAnn: again"]
    put = lambda md, who: spark.createDataFrame([(md, who)], "md string, who string").select(export.with_participants(F.col("md"), F.col("who"))).first()[0]
    md = put("# T\n\n- Date: x\n\n## Transcript\nhi", "Ann,  Bob")
    assert md == "# T\n\n- Date: x\n- Participants: Ann, Bob\n\n## Transcript\nhi\n" and put(md, "").count("- Participants: (not recorded)") == 1
    assert put("# T\n\n## Transcript\n- no head", "A") == "# T\n\n- Participants: A\n\n## Transcript\n- no head\n" and put("x", "A") == "- Participants: A\nx\n" and put(None, "A") is None
    df = spark.createDataFrame([(md,), ("none",), ("- 参与人员：（未记录）",)], "md string")
    assert [r[0] for r in df.select(export.participants_of(F.col("md"))).collect()] == ["Ann, Bob", None, ""]
    names = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a-2.md"), (4, "a.md"), (5, "b")], "k int, name string")
    assert rows(library.numbered_names(names, "k", "name").select("k", "unique_name")) == [(1, "a.md"), (2, "a-3.md"), (3, "a-2.md"), (4, "a-4.md"), (5, "b")]


def test_versions(spark, tmp_path):
    v = export.Versions(spark, str(tmp_path / "store"))
    assert v.current() is None
    first = v.write(spark.range(3))
    second = v.write(spark.range(5), expected=first)
    assert v.read().count() == 5 and v.read(first).count() == 3 and v.versions() == sorted([first, second])
    with pytest.raises(RuntimeError):
        v.write(spark.range(1), expected=first)
    v.restore(first)
    assert v.read().count() == 3
    assert export.archive([("a.md", "1"), ("a.md", "2"), ("b", "3")], str(tmp_path / "z.zip")) == 3
