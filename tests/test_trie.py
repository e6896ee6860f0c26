"""Flat tries against plain Python, and the operators that use them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.operators import trie as tries
from cohortry.operators.names import standardise
from cohortry.operators.rules import fill_by_automaton, fill_by_pattern
from cohortry.operators.skew import BroadcastLimit
from cohortry.operators.trie import NO_RULE, DictionaryTrie, PatternTrie

RULES = dict(name="name", code="code", rule_pattern="p", rule_code="c", order="o")
SHORT = st.text("ab片😀", max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(SHORT, unique=True, max_size=12), st.lists(st.text("ab片😀x", max_size=40), max_size=6))
def test_first_ranks(patterns, texts):
    found = PatternTrie.of(pa.array(patterns, pa.string())).first_ranks(pa.array(texts, pa.string()))
    assert found.tolist() == [min((i for i, p in enumerate(patterns) if p in t), default=NO_RULE) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(SHORT, unique=True, max_size=12), st.lists(st.text("ab片😀x", max_size=12), max_size=6), SHORT)
def test_walk(words, texts, suffix):
    trie = DictionaryTrie.of(pa.array(words, pa.string()), pa.table({"word": pa.array(words, pa.string())}))
    known = {w[:i] for w in words for i in range(len(w) + 1)}
    ordered = trie.values.column("word").to_pylist()
    node = trie.walked(pa.array(texts, pa.string()))
    below = trie.followed(node, suffix)
    for text, entry, reached, longer in zip(texts, trie.entries(node), below, trie.entries(below)):
        taken = ""
        for c in text:
            taken += c if taken + c in known else ""
        assert (ordered[entry] if entry >= 0 else None) == (taken if taken in words else None)
        assert not suffix or (reached > 0) == (taken + suffix in known)
        if suffix and reached:
            assert (ordered[longer] if longer >= 0 else None) == (taken + suffix if taken + suffix in words else None)


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(tries, "WINDOW", 8)
    draw = random.Random(2)
    patterns = sorted({"".join(draw.choices("ab", k=draw.randint(3, 9))) for _ in range(25)})
    texts = ["".join(draw.choices("aabx", k=n)) for n in (0, 7, 36, 37, 5000)]
    found = PatternTrie.of(pa.array(patterns)).first_ranks(pa.array(texts))
    assert found.tolist() == [min((i for i, p in enumerate(patterns) if p in t), default=NO_RULE) for t in texts]


def test_bytes_per_edge():
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(4, 14))) for _ in range(100_000)})
    patterns = PatternTrie.of(pa.array(words))
    edges = patterns.trie.nodes - 1
    assert patterns.trie.nbytes < 6.1 * edges and patterns.nbytes < 14.1 * edges
    # slices of larger arrays
    part = pa.array(words).slice(100, 50)
    copied = pa.array(part.to_pylist())
    assert np.array_equal(PatternTrie.of(part).first_ranks(part), PatternTrie.of(copied).first_ranks(copied))


@pytest.mark.parametrize("limit", [None, BroadcastLimit(bytes=1 << 20)])
def test_fifty_thousand_rules_and_long_names(spark, limit):
    """With and without the rules cut into several automata; no pattern is missed inside a very long name."""
    draw = random.Random(8)
    patterns = sorted({"".join(draw.choices("abcdefgh", k=draw.randint(7, 12))) for _ in range(50_000)})
    order = list(range(len(patterns)))
    draw.shuffle(order)
    rules = spark.createDataFrame([(p, f"C{p}", o) for p, o in zip(patterns, order)], "p string, c string, o int")
    rank = dict(zip(patterns, order))
    names = ["".join(draw.choices("abcdefgh ", k=n)) for n in [30] * 500 + [10_000] * 4]
    names += ["z" * 5000 + patterns[77] + "z" * 5000, names[0], None]
    catalog = spark.createDataFrame([(i, n, "K" if i % 50 == 1 else None) for i, n in enumerate(names)], "i int, name string, code string")
    found = fill_by_automaton(catalog, rules, **RULES, **({"limit": limit} if limit else {}))

    def first(name):
        hits = [name[i:i + k] for k in range(7, 13) for i in range(len(name) - k + 1) if name[i:i + k] in rank]
        return "C" + min(hits, key=rank.get) if hits else None

    want = ["K" if i % 50 == 1 else n and first(n) for i, n in enumerate(names)]
    assert [r.code for r in found.orderBy("i").collect()] == want


def test_catalog_is_not_shuffled(spark):
    catalog = spark.range(1000).selectExpr("id", "concat('name ', id % 7) AS name", "CAST(NULL AS string) AS code")
    rules = spark.createDataFrame([("e 3", "C", 1)], "p string, c string, o int")
    plan = fill_by_automaton(catalog, rules, **RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_values_of_other_types(spark):
    catalog = spark.createDataFrame([(0, "abc", None, None), (1, "b", None, None)], "i int, name string, code int, std date")
    rules = spark.sql("SELECT 'b' AS p, 7 AS c, date'2020-02-03' AS s, struct(1.5D AS x, 'y' AS y) AS o UNION ALL SELECT 'a', 8, NULL, struct(1.0D, 'z')")
    for fill in (fill_by_automaton, fill_by_pattern):
        rows = fill(catalog, rules, standard="std", rule_standard="s", **RULES).orderBy("i").collect()
        assert [(r.code, str(r.std)) for r in rows] == [(8, "None"), (7, "2020-02-03")]


def test_large_dictionary_is_walked_in_tasks(spark):
    """Beyond the 50,000 words that fitted as a set of prefixes."""
    words = spark.range(120_000).selectExpr("concat('w', hex(id), 'x') AS medical_name", "string(id) AS atc", "id AS ord")
    names = spark.range(0, 120_000, 997).selectExpr("id", "concat('-w', hex(id), '.x') AS name")
    found = standardise(names, words, name="name")
    assert found.filter("code = string(id)").count() == names.count()
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_with_result_columns_are_refused(spark):
    words = spark.createDataFrame([("a", "1", 1)], "medical_name string, atc string, ord int")
    with pytest.raises(ValueError, match="code"):
        standardise(spark.createDataFrame([("a", "x")], "name string, code string"), words, name="name")
