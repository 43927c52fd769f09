"""Cleaning, timing, joining and cutting of speech."""

import random

from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.operators import budget, sequence
from colloquy.operators.ordered import Ordered

from .conftest import rows


def segs(spark, data):
    full = [(m, i, s, e, t, who, g, ns, lp) for i, (m, s, e, t, who, g, ns, lp) in enumerate(data)]
    return spark.createDataFrame(full, schemas.SEGMENTS)


def test_invented_speech_and_repeats(spark):
    say = [("are", 0.1, -0.2)] * 4 + [("…", 0.0, 0.0), ("Thank you for watching!", 0.0, 0.0), ("请不吝点赞 订阅", 0.0, 0.0), ("Thank you.", 0.2, -0.1), ("Thank you.", 0.7, -0.1), ("对", 0.9, -0.9), ("对", 0.9, -0.1), ("a longer sentence here", 0.7, -1.2), (None, None, None)]
    df = segs(spark, [("m", None, None, t, None, None, ns, lp) for t, ns, lp in say])
    got = [r.reason for r in sequence.cleaned(df).orderBy("seg_idx").collect()]
    assert got == ["", "", "repeat", "repeat", "punctuation", "phrase", "phrase", "", "phrase", "silence", "", "silence", "punctuation"]
    assert rows(sequence.removed_by_reason(sequence.cleaned(df))) == [("phrase", 3), ("punctuation", 2), ("repeat", 2), ("silence", 2)]
    leak = segs(spark, [("m", None, None, "项目例会 预算", None, None, None, None)])
    assert sequence.cleaned(leak, "本次对话可能涉及：项目例会、预算。").first().reason == "prompt-leak"
    assert sequence.cleaned(df.limit(0)).count() == 0
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["[00:01] so", "", "[00:02] so", "[00:03] so", "plain"])], "doc_id string, line_no int, line string")
    assert [r.line for r in sequence.clean_lines(lines).orderBy("line_no").collect()] == ["[00:01] so", "", "[00:02] so", "plain"]


def test_repeats_equal_brute_force_however_the_rows_lie(spark):
    rng = random.Random(5)
    data = [(f"m{rng.randrange(3)}", i, rng.choice(["a", "a", "b", "!"])) for i in range(400)]
    kept, run = {}, {}
    for m, i, t in data:
        if t == "!":
            continue
        last, n = run.get(m, (None, 0))
        run[m] = (t, n + 1 if t == last else 1)
        if run[m][1] <= 2:
            kept[m, i] = t
    df = spark.createDataFrame([(m, i, None, None, t, None, None, None, None) for m, i, t in data], schemas.SEGMENTS)
    for n in (1, 7):
        got = {(r.meeting_id, r.seg_idx) for r in sequence.cleaned(df.repartition(n)).where("reason = ''").collect()}
        assert got == set(kept)


def test_ordered_scans_equal_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(5)
    o = Ordered(df, ["k"], ["i"]).running_sum("s", F.col("v")).running_max("m", F.col("v")).last_known("l", F.col("v")).neighbour("p", F.col("v"), -1).neighbour("n", F.col("v"), 1)
    got = {r.i: r for r in o.df.collect()}
    for key in "ab":
        mine = [(i, v) for k, i, v in data if k == key]
        s, m, last = 0, None, None
        for at, (i, v) in enumerate(mine):
            s += v or 0
            m = v if m is None else m if v is None else max(m, v)
            last = v if v is not None else last
            r = got[i]
            assert (r.s, r.m, r.l) == (s, m, last)
            assert (r.p.v if r.p else "none") == (mine[at - 1][1] if at else "none")
            assert (r.n.v if r.n else "none") == (mine[at + 1][1] if at + 1 < len(mine) else "none")


def test_assembly_and_ends(spark):
    p = [("r", 0, 0.0, 30.0, 0, 0.0, "一"), ("r", 0, 0.0, 30.0, 1, 40.0, "二"), ("r", 1, 30.0, 30.0, 0, 5.0, "三")]
    df = spark.createDataFrame(p, "recording_id string, piece int, offset double, duration double, n int, sec double, text string")
    got = sequence.assembled(df).orderBy("piece", "n").collect()
    assert got[1].start_sec <= 30 and got[2].start_sec == 35.0 and got[0].end_sec == got[1].start_sec
    s = segs(spark, [("m", 1.0, None, "a", None, None, None, None), ("m", 4.0, 4.5, "b", None, None, None, None), ("m", None, None, "c", None, None, None, None), ("m", 9.0, float("nan"), "d", None, None, None, None)])
    assert [(r.seg_idx, r.end_sec) for r in sequence.filled_ends(s).orderBy("seg_idx").collect()] == [(0, 4.0), (1, 4.5), (3, 14.0)]
    c = spark.createDataFrame([("r", 0, 1.111), ("r", 1, 2.222), ("r", 2, 3.0)], "recording_id string, idx int, duration double")
    assert [r.offset for r in sequence.offsets(c).orderBy("idx").collect()] == [0.0, 1.11, 3.33]


def test_joining(spark):
    s = segs(spark, [("m", 0.0, 1.0, "比如说是", None, None, None, None), ("m", 1.2, 2.0, "那个头网", None, None, None, None), ("m", 6.0, 7.0, "下一段", None, None, None, None), ("m", 7.1, 8.0, "labelled", "A", None, None, None), ("m", 8.1, 9.0, "end", None, None, None, None)])
    got = sequence.merged(s).orderBy("first_idx").collect()
    assert [r.text for r in got] == ["比如说是，那个头网", "下一段", "labelled", "end"] and got[0].end_sec == 2.0 and got[0].pieces == 2
    long = segs(spark, [("m", i, i + 1.0, "word " * 20 + ".", None, None, None, None) for i in map(float, range(6))])
    assert [r.pieces for r in sequence.merged(long).orderBy("first_idx").collect()] == [2, 2, 2]
    assert sequence.compacted("# t\n[00:01] 一\n[00:03] 二\n[00:05] 三\n[00:07] A: x\nend") == "# t\n[00:01] 一，二，三\n[00:07] A: x\nend"
    assert sequence.paragraphs_of("first\n[00:00]\n你好。\n\n[00:12]\nOK.\nand on") == [(0, 0, "first"), (1, 0, "你好。"), (2, 12, "OK. and on")]
    assert [s for _, s, _ in sequence.spread_over("a" * 130 + ". " + "b" * 130 + ".", 10.0)] == [0.0, 5.0]
    assert sequence.spread_over("", 10.0) == []


def test_cuts_and_pieces(spark):
    assert sequence.cut_points(3000, [1180, 1250, 2390]) == [1180, 2390] and sequence.cut_points(1000, []) == []
    df = spark.createDataFrame([("r", 3000.0, [1180.0, 2390.0]), ("s", None, None), ("t", 3000.0, None)], "recording_id string, total double, silences array<double>")
    assert rows(sequence.cuts(df)) == [("r", 0, 1180.0), ("r", 1, 2390.0), ("t", 0, 1200.0), ("t", 1, 2400.0)]
    v = spark.createDataFrame([("前言\n[00:00] x", 60.0), ("[00:00] x", 60.0), ("[00:00] x", 600.0), ("[00:00] (silence)", 600.0)], "t string, d double")
    assert [r[0] for r in v.select(sequence.valid_piece(F.col("t"), F.col("d"))).collect()] == [False, True, False, True]
    assert sequence.piece_in("```\n[00:00] 你好\n```", 60) == "[00:00] 你好" and sequence.piece_in("thinking\n[00:01] real one", 60) == "[00:01] real one" and sequence.piece_in("no", 60) is None
    m = spark.createDataFrame([([1.0, 5.0, 9.0], [2.0, 6.0])], "s array<double>, e array<double>")
    assert m.select(sequence.silence_middles(F.col("s"), F.col("e"))).first()[0] == [1.5, 5.5]


def test_voice(spark):
    quiet, loud = 0.001, 0.5
    frames = [quiet] * 20 + [loud] + [quiet] * 5 + [loud] * 10 + [quiet] * 24
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(frames)] + [("q", i, quiet) for i in range(60)], "id string, frame int, rms double")
    got = {r.id: (r.start, r.end) for r in sequence.speech_bounds(df, ["id"]).collect()}
    assert got == {"r": (2.1, 4.6), "q": (0.0, 6.0)}
    w = spark.createDataFrame([("m", "nn", 0.9), ("m", "en", 0.5), ("m", "en", 0.3), ("n", "nn", 0.4)], "m string, lang string, prob double")
    assert [(r.m, r.lang) for r in sequence.language_vote(w, ["m"]).orderBy("m").collect()] == [("m", "en"), ("n", "nn")]


def test_budgets(spark):
    items = [(g, i, random.Random(i * 7 + g).randrange(1, 60)) for g in range(3) for i in range(200)] + [(9, 0, 500)]
    df = spark.createDataFrame(items, "g int, k int, n int").repartition(4)
    want = []
    for g in sorted({x[0] for x in items}):
        used, any_ = 0, False
        for _, k, n in sorted(x for x in items if x[0] == g):
            if used + n > 300 and any_:
                continue
            want.append((g, k))
            used, any_ = used + n, True
            if used >= 300:
                break
    for block in (10_000, 7):
        assert rows(budget.greedy(df, ["g"], "k", "n", 300, block).select("g", "k")) == want
    stop = []
    for g in range(3):
        used = 0
        for _, k, n in sorted(x for x in items if x[0] == g):
            if used + n > 100:
                break
            stop.append((g, k))
            used += n + 1
    assert rows(budget.prefix(df.where("g < 3"), ["g"], ["k"], "n", 100, gap=1).select("g", "k")) == stop
    t = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, "b" * 50), (1, 2, "c" * 50), (1, 3, None)], "g int, k int, t string")
    assert [r.t for r in budget.concatenated(t, ["g"], ["k"], "t", 70, 40).orderBy("k").collect()] == ["a" * 40, "b" * 30]


def test_quantiles_of_a_key_with_most_rows(spark):
    import statistics

    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(20)}", i, rng.choice([None, float("nan"), 0.5, round(rng.random(), 2)])) for i in range(3000)] + [("one", 9000, 0.25), ("none", 9001, None)]
    got = {r.k: r.q for r in sequence.quantile(spark.createDataFrame(data, "k string, i int, v double"), ["k"], "v", "i", 0.2).collect()}
    for k in {x[0] for x in data} - {"none"}:
        v = [x for key, _, x in data if key == k and x is not None and x == x]
        assert abs(got[k] - (statistics.quantiles(v, n=5, method="inclusive")[0] if len(v) > 1 else v[0])) < 1e-9
    assert "none" not in got
