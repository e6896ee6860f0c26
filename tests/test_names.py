"""Dictionary walk and pattern rules against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators.names import dictionary_table, distinct_clean_names, match_ratio, standardise, walk_by_joins
from cohortry.operators.rules import changed_rows, fill_by_automaton, fill_by_pattern
from cohortry.operators.skew import BroadcastLimit

BOTH = [BroadcastLimit(), BroadcastLimit(rows=0)]


def dictionary(spark, words, codes=None):
    codes = codes or [f"C{i}" for i in range(len(words))]
    return spark.createDataFrame([(w, c, i) for i, (w, c) in enumerate(zip(words, codes))],
                                 "medical_name string, atc string, ord int")


def names_frame(spark, names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")


def ordered(df):
    return [tuple(r)[2:] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("limit", BOTH)
def test_walk_cases(spark, limit):
    words = dictionary(spark, ["红片", "红色片", "红（大）", "蓝", "蓝色胶囊", "红(大)"])
    names = names_frame(spark, ["红", "红色", "红色小片", "红(大)", "x蓝x", "蓝色", "绿", "", None, "红"])
    found = ordered(standardise(names, words, name="name", limit=limit))
    assert [s for s, _ in found] == ["红片", "红色片", "红色片", "红(大)", "蓝", None, None, None, None, "红片"]
    assert [c for _, c in found] == ["C0", "C1", "C1", "C5", "C3", None, None, None, None, "C0"]
    marked = standardise(names, words, name="name", missing="空值", limit=limit)
    assert ordered(marked)[8] == ("空值", None)
    ratio = match_ratio(marked).first()
    assert (ratio.n_rows, ratio.n_matched) == (10, 7)
    assert match_ratio(marked.limit(0)).first().ratio is None


def test_codes_of_repeated_and_padded_names(spark):
    words = dictionary(spark, ["a", "a", " b ", "c", "c"], ["1", "2", "3", "4", None])
    stripped = {r.word: r.code for r in dictionary_table(words, "medical_name", "atc", "ord").collect()}
    raw = {r.word: r.code for r in dictionary_table(words, "medical_name", "atc", "ord", "raw").collect()}
    assert stripped == {"a": "2", "b": "3", "c": None}
    assert raw == {"a": "2", "b": None, "c": None}


def brute_walk(name, words, suffix):
    """Follow dictionary positions directly: keep all words that start with the text taken."""
    taken = ""
    for ch in name:
        if any(w.startswith(taken + ch) for w in words):
            taken += ch
    if taken not in words or not taken:
        if any(w.startswith(taken + suffix) for w in words):
            taken += suffix
    return taken if taken in words else None


@pytest.mark.parametrize("limit", BOTH)
def test_walk_against_brute_force(spark, limit):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc片", k=rng.randint(1, 5))) for _ in range(40)})
    names = ["".join(rng.choices("abcd片", k=rng.randint(0, 9))) for _ in range(300)]
    found = ordered(standardise(names_frame(spark, names), dictionary(spark, words), name="name", limit=limit))
    code = {w: f"C{i}" for i, w in enumerate(words)}
    expected = [brute_walk(n, words, "片") for n in names]
    assert found == [(w, code.get(w)) for w in expected]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_walk_with_any_size_of_rows(spark, most):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("ab片", k=rng.randint(1, 6))) for _ in range(40)})
    names = sorted({"".join(rng.choices("abc片", k=rng.randint(0, 10))) for _ in range(200)})
    table = dictionary_table(dictionary(spark, words), "medical_name", "atc", "ord")
    found = walk_by_joins(spark.createDataFrame([(n,) for n in names], "name string"), table, "片", most)
    assert {r.name: r.standard for r in found.collect()} == {n: brute_walk(n, words, "片") for n in names}


def test_distinct_clean_names(spark):
    a = spark.createDataFrame([("(甲)药", "西药费"), ("(甲)药", "西药费"), ("床", "床位费"), (None, "药费")], "n string, c string")
    b = spark.createDataFrame([("药", "中药费"), ("(甲)药", "药费")], "n string, c string")
    assert sorted(r.n for r in distinct_clean_names([a, b], "n", "c").collect()) == ["药", "药"]


RULES = dict(name="name", code="code", rule_pattern="p", rule_code="c", order="o")
WAYS = pytest.mark.parametrize("fill", [fill_by_pattern, fill_by_automaton])
FEW = [BroadcastLimit(), BroadcastLimit(rows=2)]


@WAYS
@pytest.mark.parametrize("limit", FEW)
def test_first_rule_wins(spark, limit, fill):
    catalog = spark.createDataFrame([(0, "红色片A", None), (1, "蓝片", None), (2, "红色片B", "K"), (3, "绿", None), (4, None, None)],
                                    "i int, name string, code string")
    rules = spark.createDataFrame([("片", "C02", "s1", 1), ("红色", "C07", "s2", 2), ("绿", None, "s3", 0)], "p string, c string, s string, o int")
    catalog = catalog.withColumn("std", F.lit(None).cast("string"))
    found = fill(catalog, rules, standard="std", rule_standard="s", limit=limit, **RULES)
    assert [tuple(r)[2:] for r in found.orderBy("i").collect()] == [
        ("C02", "s1", True), ("C02", "s1", True), ("K", None, False), (None, None, False), (None, None, False)]
    assert changed_rows(found).first()[0] == 2


@WAYS
@pytest.mark.parametrize("limit", FEW)
def test_rules_against_brute_force(spark, limit, fill):
    rng = random.Random(9)
    pool = ["".join(rng.choices("ab%_药", k=rng.randint(0, 7))) for _ in range(60)]
    catalog = [(i, rng.choice(pool), rng.choice([None, None, "K"])) for i in range(400)]
    rules = [("".join(rng.choices("ab%_药", k=rng.randint(1, 4))), f"C{i}", i * 7 % 31) for i in range(31)]
    found = fill(
        spark.createDataFrame(catalog, "i int, name string, code string"),
        spark.createDataFrame(rules, "p string, c string, o int"), limit=limit, **RULES)
    expected = []
    for _, name, code in catalog:
        hits = sorted((o, c) for p, c, o in rules if p in name)
        expected.append(code or (hits[0][1] if hits else None))
    assert [r.code for r in found.orderBy("i").collect()] == expected


@WAYS
def test_empty_pattern_matches_every_name_and_no_rules_change_nothing(spark, fill):
    catalog = spark.createDataFrame([(0, "x", None), (1, "", None), (2, None, None)], "i int, name string, code string")
    everything = spark.createDataFrame([("", "C", 1)], "p string, c string, o int")
    found = fill(catalog, everything, **RULES)
    assert [r.code for r in found.orderBy("i").collect()] == ["C", "C", None]
    assert changed_rows(fill(catalog, everything.limit(0), **RULES)).first()[0] == 0
