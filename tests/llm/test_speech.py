"""Problems 2 and 3."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import encodings, languages, turns

from ..conftest import rows

PEOPLE = "Anna Berg; Carl Dorn, 韩龙炜"


def read(*lines, who=PEOPLE):
    return turns.read(list(lines), [who] * len(lines))


def test_lines():
    got = read(
        "[00:03] Anna Berg: Let me repeat that: the plan comes first.", "BERG, ANNA - [music]", "Carl [Host]: Um.", "Let me repeat that: the plan comes first.", "韩 龙炜（主持）：呃，预算还卡着。", "龙炜  00:01:02",
        "ATENÇÃO: A REVISÃO NÃO ESTÁ PRONTA", "", "Er... uh.", "♪♪", "<v carl_dorn>Bolo Foods asked us twice.</v>", "Ben: hello", "A. Berg: (312) 555-0144",
    )
    assert [s for s, _, _ in got] == ["Anna Berg", "Anna Berg", "Carl Dorn", None, "韩龙炜", "韩龙炜", None, None, None, None, "Carl Dorn", None, "Anna Berg"]
    assert [x for _, _, x in got] == [True, False, False, True, True, False, True, False, False, False, True, True, True]
    assert [t for _, t, _ in got][0] == 3.0 and got[5][1] == 62.0
    assert turns.resolve("SPEAKER_02", "") == turns.resolve("发言人 2", "") == "Speaker 2"
    assert turns.resolve("Sam", "Sam Gold, Sam Reed") is None and turns.resolve("Sam Reed", "Sam Gold, Sam Reed") == "Sam Reed"
    assert turns.resolve("Gwendolyn Sölund".encode().decode("cp1252"), "Gwendolyn Sölund") == "Gwendolyn Sölund"
    long = "um " * 500 + "yes we did"
    assert read(long)[0][2] is True  # what is said late in a line counts


def test_batches_decode_like_single_lines():
    rng = random.Random(2)
    lines = [[rng.randrange(1, len(turns.CLASSES)) for _ in range(rng.randrange(0, 40))] for _ in range(200)]
    t = turns.tagger()
    for line, path in zip(lines, t.decode(lines), strict=True):
        assert list(t.decode([line])[0]) == list(path) and len(path) == len(line)


def seg(spark, data):
    rows_ = [(m, k, s, who, x, p) for m, k, s, who, x, p in data]
    return spark.createDataFrame(rows_, "record_id string, seq string, start_sec double, speaker string, text string, participants string").withColumn("seg_idx", F.col("seq").cast("bigint"))


def test_turns(spark):
    data = [
        ("m", "0", 5.0, "Carl", "second thing", PEOPLE), ("m", "1", 1.0, "Anna Berg", "first thing", PEOPLE), ("m", "2", 6.0, None, "um", PEOPLE), ("m", "3", 7.0, None, "goes on", PEOPLE),
        ("m", "4", 8.0, "A. Berg", "[music]", PEOPLE), ("m", "5", 9.0, None, "still Carl", PEOPLE), ("n", "0", None, None, None, None), ("n", "1", None, None, "who is it", None), ("o", "0", None, "Spk 01", "", ""),
    ]
    empty = spark.createDataFrame([], "origin string, record_id string, text string, participants string")
    got = turns.turns(turns.lines_of(seg(spark, data), empty))
    assert rows(got.select("record_id", "first_pos", "speaker", "lines"), "record_id", "first_pos") == [("m", 0, "Carl Dorn", 3), ("m", 1, "Anna Berg", 1), ("n", 1, None, 1)]
    text = "Weekly sync\n\nAnna Berg  00:00:09\nlater words\n\nCarl Dorn  00:00:02\n[laughter]\nfirst words\nand more"
    t = spark.createDataFrame([("transcripts", "t", text, PEOPLE), ("imports", "mail", "From: a <a@b.c>\nSubject: x\n\nAnna Berg: hi\nCarl Dorn: ho", PEOPLE), ("imports", "notes", "# Plan\nwe met", PEOPLE), ("transcripts", "z", None, None), ("imports", "e", "", PEOPLE)], "origin string, record_id string, text string, participants string")
    got = turns.turn_starts(turns.lines_of(seg(spark, []), t))
    assert rows(got) == [("transcripts", "t", 4, "Anna Berg"), ("transcripts", "t", 8, "Carl Dorn")]


def test_turns_don_t_depend_on_how_rows_lie(spark):
    rng = random.Random(4)
    who, want, last = ["Anna Berg", "Carl Dorn", None], [], None
    data = []
    for i in range(600):
        s, x = rng.choice(who), rng.choice(["words here", "words here", "um"])
        data.append(("m", str(i), float(i), s, x, PEOPLE))
        if x == "um":
            continue
        now = s or last
        if not want or now != last:
            want.append((i, now))
        last = now
    empty = spark.createDataFrame([], "origin string, record_id string, text string, participants string")
    for n in (1, 9):
        got = turns.turn_starts(turns.lines_of(seg(spark, data).repartition(n), empty))
        assert sorted((r.first_pos, r.speaker) for r in got.collect()) == want


def test_turns_give_the_clean_text(spark):
    long = "The client accepted the plan, er, which surprised all of us and everyone else in the team at 16:30, because nobody (applause) had um expected it."
    clean = "The client accepted the plan which surprised all of us and everyone else in the team at 16:30, because nobody had expected it."
    data = [
        ("m", "0", 1.0, None, "[00:01] Anna Berg: Um, we agreed to send the quote. [music]", PEOPLE), ("m", "1", 2.0, None, "uh", PEOPLE), ("m", "2", 3.0, None, long, PEOPLE),
        ("m", "3", 4.0, None, "A. Berg: (312) 555-0144", PEOPLE), ("m", "4", 5.0, None, "<v carl_dorn>Bolo Foods asked us, uh, twice.</v>", PEOPLE), ("m", "5", 6.0, None, "韩 龙炜（主持）：呃，预算还卡着。 ♪", PEOPLE),
    ]
    text = "Carl Dorn  00:00:02\nUm, first words\n[laughter]\nand more, you know, of them\n\nAnna Berg  00:00:09\nlater words"
    t = spark.createDataFrame([("transcripts", "t", text, PEOPLE)], "origin string, record_id string, text string, participants string")
    got = turns.turns(turns.lines_of(seg(spark, data), t).repartition(3))
    assert rows(got.select("record_id", "turn_no", "speaker", "text"), "record_id", "turn_no") == [
        ("m", 1, "Anna Berg", f"we agreed to send the quote. {clean} (312) 555-0144"), ("m", 2, "Carl Dorn", "Bolo Foods asked us twice."), ("m", 3, "韩龙炜", "预算还卡着。"),
        ("t", 1, "Carl Dorn", "first words and more of them"), ("t", 2, "Anna Berg", "later words"),
    ]


LINES = {
    "en": "the plan is still blocked and nobody knows why|we agreed to send the revised quote by friday|could somebody call the client back|there is a gap in the budget of the team",
    "fr": "le client accepte la maquette mais veut revoir les détails|nous avons convenu de rédiger la synthèse|rien n'a bougé depuis le dernier appel|il manque encore un budget pour les équipes",
    "de": "das würde ungefähr so viel mehr kosten als geplant|wir wollen bis freitag beide anbieter vergleichen|der vertrag hängt noch fest und niemand weiß warum|kann jemand den raum buchen",
    "es": "el equipo dedicó muchas horas a este asunto la semana pasada|desde la última llamada no ha cambiado nada|todavía nos falta un por ciento|alguien puede enviar el presupuesto corregido",
    "pt": "a equipe gastou muitas horas com isso na semana passada|não mudou nada desde a última ligação|ainda nos faltam por cento|combinamos de rever os números até sexta",
    "zh": "我们说好周五之前订好会议室。|这样算下来会比原计划多出很多。|客户认可这个方案，不过还想再看一遍细节。|老系统下线以后预算怎么办？",
}


@pytest.fixture(scope="module")
def profiles():
    return languages.train([(x, k) for k, v in LINES.items() for x in v.split("|")] * 3)


def test_runs(profiles):
    text = "\n[00:01] Anna Berg:\nThe budget of the client is blocked and nobody knows why.\nUm.\n\nwir wollen den Raum bis Freitag buchen und vergleichen\n包装公司 wir wollen den Vertrag vergleichen\n我们说好周五之前再看一遍方案，客户认可。\n[music]"
    assert [r[:3] for r in languages.runs(text, profiles)] == [(1, 5, "en"), (6, 7, "de"), (8, 9, "zh")]
    assert languages.runs("", profiles) == languages.runs("[00:01]\n12\n\n", profiles) == []
    assert all(0 < r[3] <= 1 for r in languages.runs(text, profiles))


def test_labels(spark, profiles):
    en = "the plan is still blocked and nobody knows why"
    data = [("imports", str(i), en, x) for i, x in enumerate((None, "", "auto", "en", "EN", "en_US", "English", "fr", "ja"))] + [("imports", "n", None, "en"), ("imports", "mix", f"{en}\n我们说好周五之前订好会议室。", "en")]
    df = spark.createDataFrame([(*r, 0.5) for r in data], "origin string, record_id string, text string, lang string, confidence double")
    got = languages.mislabelled(languages.languages(df, profiles))
    assert rows(got.select("record_id", "first_line", "lang")) == [("0", 1, "en"), ("1", 1, "en"), ("2", 1, "en"), ("7", 1, "en"), ("8", 1, "en"), ("mix", 1, "en"), ("mix", 2, "zh")]
    assert languages.languages(df.limit(0), profiles).count() == 0
    assert languages.code("pt-BR") == "pt" and languages.code("French") == "fr" and languages.code(None) is None


def test_held_out_accuracy(spark):
    """On labelled documents the prototypes were not fitted on."""
    import os

    import pandas as pd

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    d = pd.read_parquet(path).sort_values("doc_id")
    p = languages.train([(x, r.lang) for r in d.iloc[::2].itertuples() for x in r.text[:4000].split("\n")])
    held = d.iloc[1::2].head(250)
    right = [max(languages.runs(r.text, p), key=lambda x: x[1] - x[0], default=(0, 0, "?"))[2] == r.lang for r in held.itertuples()]
    assert sum(right) / len(right) > 0.97
    m = encodings.model_of(spark.createDataFrame(d.iloc[::2][["text"]]))
    assert not any(encodings.affected(x, m) for t in held.text for x in t.split("\n"))


def test_cosines_are_those_of_the_bundled_vectors():
    import math

    import numpy as np

    lines = [("The birds came back to the river this morning.", "en"), ("Les oiseaux sont revenus au bord de la rivière.", "fr"), ("Die Vögel kamen heute früh an den Fluss zurück.", "de"), ("早上河边的鸟又飞回来了。", "zh")]
    p = languages.train(lines)
    assert np.allclose(np.linalg.norm(p.protos[:4], axis=1), 1, atol=1e-5)
    for line, _ in lines:
        ws = languages.words(line)
        v = sum(k * sum(p.vector(g).astype(float) for g in languages.grams(w)) / math.sqrt(len(languages.grams(w))) for w, k in ws)
        exact = p.protos @ v / np.linalg.norm(v)
        got, length = p.cosines(line)
        assert np.abs(got - exact).max() < 0.15 and np.argmax(got) == np.argmax(exact) and abs(length / np.linalg.norm(v) - 1) < 0.25
    assert p.cosines("12:30 -- ") is None


def test_a_turn_without_end_comes_in_parts(spark):
    n = 2_345
    df = spark.range(n).selectExpr("'segments' as origin", "'m' as record_id", "id as pos", "cast(id as double) as at", "case when id = 0 then 'Ann' when id = 2000 then 'Bob' end as speaker", "true as spoken", "concat('w', id) as said").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = turns.turns(df, 300).orderBy("turn_no", "part").collect()
        starts = rows(turns.turn_starts(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [(r.turn_no, r.part, r.first_pos, r.last_pos, r.lines, r.speaker) for r in got] == [(1, k, 300 * k, min(300 * k + 299, 1999), min(300, 2000 - 300 * k), "Ann") for k in range(7)] + [(2, 0, 2000, 2299, 300, "Bob"), (2, 1, 2300, 2344, 45, "Bob")]
    assert " ".join(r.text for r in got).split() == [f"w{i}" for i in range(n)] and starts == [("segments", "m", 0, "Ann"), ("segments", "m", 2000, "Bob")]
