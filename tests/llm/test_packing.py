"""Problems 7, 8 and 9."""

import random

import pytest

from colloquy.llm import mixing, packing, pieces
from colloquy.llm import tokens as tk

from ..conftest import rows

DOC = "doc_id bigint, text string, source string, tokens int, shard int, h string"


def docs(spark, *data):
    return spark.createDataFrame([(i, t, s, 7, 7, "clash") for i, (t, s) in enumerate(data)], DOC)


def slow_pack(items, capacity, conflicts):
    """One item after the other, by looking at every container."""
    bins = []
    copies = {c: sum(x[2] == c for x in items) for _, _, c in items}
    order = sorted(range(len(items)), key=lambda i: (-copies[items[i][2]] if copies[items[i][2]] > 1 else 0, -items[i][0], items[i][1], items[i][2], i))
    for i in order:
        size, source, cluster = items[i]
        fit = [b for b in bins if b["left"] >= size and b["left"] and cluster not in b["clusters"] and not any((source, s) in conflicts or (s, source) in conflicts for s in b["sources"])]
        b = min(fit, key=lambda b: (b["left"], b["no"]), default=None)
        if b is None:
            b = {"left": capacity, "no": len(bins), "clusters": set(), "sources": set(), "items": []}
            bins.append(b)
        b["left"] -= size
        b["clusters"].add(cluster)
        b["sources"].add(source)
        b["items"].append(i)
    return bins


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for trial in range(20):
        items = [(rng.randrange(1, 60), rng.choice("xyz"), f"c{rng.randrange(25)}") for _ in range(80)]
        items = [(sum(map(ord, c)) % 50 + 1, s, c) for _, s, c in items]  # copies have one size
        conflicts = [("x", "y")] if trial % 2 else []
        where = packing.pack(items, 100, conflicts)
        bins = slow_pack(items, 100, conflicts)
        assert len(set(where)) == len(bins)
        for b in set(where):
            inside = [items[i] for i in range(len(items)) if where[i] == b]
            assert sum(x[0] for x in inside) <= 100 and len({x[2] for x in inside}) == len(inside)
            assert not conflicts or not {"x", "y"} <= {x[1] for x in inside}


def test_containers(spark):
    rng = random.Random(2)
    words = "plan budget client quote team friday room meeting".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    data = [(text(rng.randrange(1, 90)), rng.choice("ab")) for _ in range(200)] + [("same text", "a")] * 20 + [("Same  text ", None), (None, "b"), ("", None), (text(600), "a")]
    df = docs(spark, *data)
    out = packing.containers(df, 250)
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(len(data))) and all(r.used <= 250 for r in got)
    assert all(r.tokens == tk.count((data[r.doc_id][0] or "")[r.start_pos : r.end_pos]) for r in got)
    for doc in range(len(data)):  # every text is whole, or its pieces are one after the other
        mine = sorted((r.piece_no, r.start_pos, r.end_pos, r.n_pieces) for r in got if r.doc_id == doc)
        assert mine[0][1] == 0 and mine[-1][2] == len(data[doc][0] or "") and all(x[2] == y[1] for x, y in zip(mine, mine[1:], strict=False)) and len(mine) == mine[0][3]
    assert rows(packing.oversized(out)) == [(len(data) - 1,)]
    same = [r.container_id for r in got if 200 <= r.doc_id <= 220]
    assert len(set(same)) == 21
    assert packing.container_report(out).first().unused_share < 0.2
    assert packing.containers(df.limit(0), 250).count() == 0
    assert packing.containers(df.unionByName(df), 250).count() == len(got)
    with pytest.raises(ValueError):
        packing.containers(df, 0)


def test_mix(spark):
    data = [("word " * 20, "big")] * 60 + [("word " * 20, "small")] * 3 + [("word " * 20, "other")] * 30 + [("x", None), (None, "big"), ("", "small")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 2), ("none", 0.1, 5), ("other", 0.2, None)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(docs(spark, *data), targets, range_rows=10)
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].passes == 2 and rep["small"].short and rep["none"].short and not rep["big"].short and not rep["other"].short
    got = mixed.collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    seen = {}
    for r in got:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(v for k, v in seen.items() if 60 <= k < 63) == 2 and all(v == 1 for k, v in seen.items() if not 60 <= k < 63)
    total = sum(tk.count(t) for t, _ in data)
    assert sum(r.tokens for r in got) <= total
    again = mixing.mix(docs(spark, *data).repartition(7), targets, range_rows=1000)[0].collect()
    assert [(r.doc_id, r.pass_no) for r in again] == [(r.doc_id, r.pass_no) for r in got]
    # by brute force: every queue sends in its order until the cut
    until = mixing.finish_cut([0.5, 0.2], [100.0, 10.0], 60.0)
    assert abs(min(until * 0.5, 100) + min(until * 0.2, 10) - 60) < 1e-9
    assert mixing.mix(docs(spark).limit(0), targets)[1].where("short").count() == 0
    twice = mixing.mix(docs(spark, *data).unionByName(docs(spark, *data)), targets)[1]
    assert rows(twice.select("source", "source_tokens", "short")) == rows(report.select("source", "source_tokens", "short"))
    less = {r.source: r.short for r in mixing.mix(docs(spark, *data), targets, budget=100)[1].collect()}
    assert less == {"big": False, "small": False, "none": True, "other": False}  # 40 times 3 is over a fifth of 100
    assert mixing.mix(docs(spark), targets)[0].count() == 0


def test_pieces(spark):
    sentence = "We agreed to send the revised quote by Friday. "
    texts = [sentence * 60, "para one.\n\n" * 300, "x" * 9000, "我们说好周五之前订好会议室。" * 200, "short", "", None, "a\nb " * 1500]
    for t in texts:
        if not t:
            continue
        got = pieces.split(t, 200, 20)
        assert got[0][0] == 0 and got[-1][1] == len(t) and all(n <= 200 for _, _, n, _ in got)
        for (a, b, _, _), (c, d, _, _) in zip(got, got[1:], strict=False):
            assert a < c <= b < d
            assert 0 < tk.count(t[c:b]) <= 23
    assert {k for *_, k in pieces.split(sentence * 60, 200, 20)} == {"sentence", "end"}
    assert "hard" in {k for *_, k in pieces.split("x" * 9000, 200, 20)}
    df = docs(spark, *[(t, "s") for t in texts])
    out = pieces.pieces(df, 200, 20)
    assert {r.doc_id for r in out.collect()} == {i for i, t in enumerate(texts) if t and tk.count(t) > 200}
    first = out.where("doc_id = 0").orderBy("piece_no").collect()
    assert all(r.text == texts[0][r.start_pos : r.end_pos] for r in first) and [r.piece_no for r in first] == list(range(len(first)))
    assert pieces.pieces(df.limit(0), 200, 20).count() == 0
    with pytest.raises(ValueError):
        pieces.split("x", 10, 10)


def test_tokens():
    text = "déjà 会议 👍 done\n" * 50
    e = tk.ends(text)
    assert e[-1] == len(text) and (e[1:] >= e[:-1]).all() and len(e) == tk.count(text)
    long = "word " * 30_000
    assert abs(tk.count(long) - 30_000) <= 10 and "".join(tk.blocks(long)) == long
    assert tk.count(None) == tk.count("") == 0
    plain = tk.encoder().encode_ordinary
    for text in ("我们说好周五之前订好会议室，后面就轻松多了。" * 2500, "a,b;c's 12.5%\n\n  x" * 3000, "wörd’s " * 9000, "漢字" * 4000 + "。" + "かな" * 9000):
        assert tk.count(text) == len(plain(text)) and tk.ends(text)[-1] == len(text)
