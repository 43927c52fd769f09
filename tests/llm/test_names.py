"""Problem 1."""

import random
from itertools import product

from pyspark.sql import functions as F

from colloquy.llm import names as N

from ..conftest import rows

SCHEMA = "entity_id string, entity_type string, name string, aliases array<string>, updated timestamp, root string, word string"


def clusters(spark, *entries):
    df = spark.createDataFrame([(f"e{i:02}", t, n, a, None, "clash", "clash") for i, (t, n, a) in enumerate(entries)], SCHEMA)
    got = {}
    for r in N.groups(df).collect():
        got.setdefault(r.cluster_id, set()).add(int(r.entity_id[1:]))
    return sorted(map(sorted, got.values()))


def test_parts():
    assert N.person("Dr. Ann M. Hörlund") == N.person("hörlund, ann") == [("full", "ann horlund", ["ann", "horlund"])]
    assert N.person("A. Horlund") == N.person("ahorlund") == [("initial", "a. horlund", ["horlund", "a"])]
    assert N.person("Ann H.") == N.person("Ann") == N.person("") == N.person("小王") == N.person("王总") == []
    assert N.person("彭杰辉（外部）")[0] == N.person("彭杰晖")[0] and N.person("彭杰辉")[1][1] == N.person("PENG Jiehui")[0][1]
    assert N.firm("The Nimoto Eng. Group")[0][1] == "eng nimoto" and N.firm("NEG") == [] and N.firm("Nimoto Inc.") == [("core", "nimoto", ["nimoto"])]
    assert N.firm("南湾岳穗赫包装集团")[0][1] in ("岳穗赫 包装", "南湾岳穗赫 包装") and N.firm("岳穗赫包装有限公司")[0][1] == "岳穗赫 包装"
    assert N.shortened("mfg", "manufacturing") and N.shortened("eng", "engineering") and N.shortened("brgs", "bearings") and not N.shortened("media", "metals")


def test_groups(spark):
    got = clusters(
        spark,
        ("person", "Konstantin Orvolkeshaw", []), ("person", "Kostya", ["Konstantin Orvolkeshaw"]), ("person", "ORVOLKESHAW Kostya", []), ("person", "K. Orvolkeshaw", []),
        ("person", "Konstantin Orvokleshaw", []), ("person", "korvolkeshaw", []), ("person", "Olivia Orvolkeshaw", []), ("person", "Kostya", []), ("person", None, None), ("person", "", [""]),
        ("project", "Nimoto Eng. Ltd", []), ("project", "Engineering, Nimoto", []), ("project", "Nimoto Media", []), ("project", "Konstantin Orvolkeshaw", []),
        ("term", "Nimoto Engineering", []),
    )
    assert got == [[0, 1, 2, 3, 4, 5], [6], [7], [8], [9], [10, 11], [12], [13]]
    both = clusters(spark, ("person", "Lawrence Hestalow", []), ("person", "Leonard Hestalow", []), ("person", "L. Hestalow", []))
    assert both == [[0], [1], [2]]  # an initial that fits two people is nobody's
    assert clusters(spark) == []


def test_short_forms_of_names_in_no_table(spark):
    for short, full in (("mike", "michael"), ("jim", "james"), ("dave", "david"), ("tom", "thomas"), ("ben", "benedict"), ("tony", "anthony"), ("max", "maxwell")):
        assert N.same_given(short, full) and N.same_given(full, short), full
    assert not N.same_given("jim", "joan") and not N.same_given("be", "benedict")
    got = clusters(spark, ("person", "Mike Orvolkeshaw", []), ("person", "Michael Orvolkeshaw", []), ("person", "Ben Hestalow", []), ("person", "Benedict Hestalow", []))
    assert got == [[0, 1], [2, 3]]


def test_common_words_link(spark):
    given = [f"{a}{b}{c}" for a in ("qua", "zor", "wex", "jyf", "vub") for b in ("lti", "ngo", "rpu") for c in ("mda", "sko", "xev", "hnu")]
    people = [("person", f"{g} Orvolkeshaw", []) for g in given] + [("person", f"Hubert {g[::-1]}stone", []) for g in given] + [("person", "Hubert Orvolkeshaw", []), ("person", "Hubertt Orvolkeshaw", []), ("person", "Hubie Orvolkeshaw", []), ("person", "H. Orvolkeshaw", [])]
    firms = [("project", f"{g} Logistics", []) for g in given] + [("project", "Zephyr Logistics", []), ("project", "Zphr Logistics", [])]
    groups = clusters(spark, *people, *firms)
    n = len(people)
    assert [n - 4, n - 3, n - 2, n - 1] in groups and [n + len(firms) - 2, n + len(firms) - 1] in groups


def test_words_many_firms_have_make_no_pairs(spark):
    names = ["".join(w) for w in product("bdfgklmnprstvz", "aeiou", "bdfgklmnprstvz", "aeiou")][::3]  # words of four letters allow no slips
    n = len(names)
    firms = [("project", f"{x} Logistics Berlin", []) for x in names] + [("project", f"Berlin Logistcs {names[7]}", []), ("project", f"{names[9]} Logistics Hamburg", [])]
    df = spark.createDataFrame([(f"e{i:05}", t, x, a, None, "", "") for i, (t, x, a) in enumerate(firms)], SCHEMA)
    pairs, made = N.full_pairs, []
    N.full_pairs = lambda *x: made.append(pairs(*x)) or made[-1]
    try:
        got = {r.entity_id: r.cluster_id for r in N.groups(df).collect()}
    finally:
        N.full_pairs = pairs
    assert got[f"e{n:05}"] == got["e00007"] == "e00007" and got[f"e{n + 1:05}"] == f"e{n + 1:05}" and len(set(got.values())) == n + 1
    assert n > 1400 and made[0].count() < 3 * n


def test_slips_of_spellings_many_have(spark):
    got = clusters(spark, *[("person", x, []) for x in ("Hubert Orvolkeshaw", "Hubert Orvolkeshaw", "Hubertt Orvolkehsaw", "Hubertt Orvolkehsaw")], *[("project", x, []) for x in ("Zephyr Orbit Coastal Logistics", "Zephyr Orbit Coastal Logistcs", "Zephyr Orbit Coastal Insurance")])
    assert got == [[0, 1, 2, 3], [4, 5], [6]]


def test_automaton_counts_as_the_table_does():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        for most in (0, 1, 2):
            machine = N.Automaton(a, most)
            assert dict(N.Trie([b]).near(machine)).get(b, most + 1) == min(N.slips(a, b), most + 1), (a, b, most)


def test_firms_by_all_their_words_and_rare_chinese_family_names(spark):
    got = clusters(
        spark,
        ("project", "Nimeshiglo Ceramics Trading Berlin", []), ("project", "Nimeshiglo Ceramics Trading Hamburg", []), ("project", "Nimeshiglo Ceramcis Trading Berlin", []),
        ("person", "欧阳明华", []), ("person", "欧阳明华", []), ("person", "阚清泽", []), ("person", "阚清泽", []), ("person", "明华", []), ("person", "明华", []),
    )
    assert got == [[0, 2], [1], [3, 4], [5, 6], [7], [8]]


def test_pairs(spark):
    df = spark.createDataFrame([("b", "person", "a"), ("a", "person", "a"), ("c", "person", "a"), ("d", "project", "d")], "entity_id string, entity_type string, cluster_id string")
    assert rows(N.pairs(df)) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_trie_join_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 13))) for _ in range(120)]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcde") + w[i:], w[:i] + rng.choice("abcde") + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w])

    words = sorted({w for b in base for w in (b, slip(b), slip(slip(b))) if w})
    want = {(a, b): n for a in words for b in words if a != b and (n := N.slips(a, b)) <= N.bound(a, b)}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for crowded in (200, 3):  # the second way, shards by more letters, finds the same
        assert {(r.word, r.other): r.slips for r in N.trie_join(table, crowded).collect()} == want
    assert all(set(N.keys_of(a)) & set(N.keys_of(b)) and set(N.keys_of(a, 24)) & set(N.keys_of(b, 24)) for a, b in want)
    assert N.slips("abcd", "abdc") == 1 and N.slips("abc", "xyz") == 3


def test_copies_cost_nothing_twice(spark):
    many = spark.range(300).select(F.format_string("e%03d", "id").alias("entity_id"), F.lit("person").alias("entity_type"), F.lit("Ann Horlund").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("timestamp").alias("updated"))
    g = N.groups(many)
    assert g.select("cluster_id").distinct().count() == 1 and N.pairs(g).count() == 300 * 299 // 2


def test_no_side_of_a_join_is_sent_to_the_driver(spark, monkeypatch):
    plans = []
    for name in ("cut", "stored"):
        def spied(df, *args, made=getattr(N.runtime, name)):
            out = made(df, *args)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(N.runtime, name, spied)
    entries = [("a", "Ann Horlund"), ("b", "Ann Horlumd"), ("c", "A. Horlund"), ("d", "Bea Quist")]
    df = spark.createDataFrame([(i, "person", n, [], None) for i, n in entries], "entity_id string, entity_type string, name string, aliases array<string>, updated timestamp")
    found = N.pairs(N.groups(df))
    assert rows(found) == [("a", "b"), ("a", "c"), ("b", "c")]
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
