"""Free-text names: cleaning, standardisation against a dictionary and code lookup.

A name is walked character by character. The walk stays on the path of a dictionary word:
a character that continues some word is taken, any other is skipped, and nothing is
taken back. The node reached is simply the text taken so far.

Dictionaries up to hundreds of thousands of words are flat tries that every task holds (`trie.py`); larger ones are
walked by joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import MEDICATION_CATEGORY_PATTERN, TABLET_SUFFIX
from ..functions.labels import fill_missing
from ..functions.text import any_like, ascii_brackets, drop_bracket_prefix, strip_text
from ..sources.shared import written
from .skew import BroadcastLimit, fits, key_profile, skew_join
from .trie import DictionaryTrie

_RESULT = "standard string, code string"

# Every Python worker holds the dictionary as a flat trie: six bytes a character at most, and the words themselves.
DICTIONARY_LIMIT = BroadcastLimit(rows=500_000, bytes=80 * 1024 * 1024)
# Nodes of a dictionary that one row may hold in the walk by joins.
LOWER_TRIE = 256


def distinct_clean_names(
    sources: Iterable[DataFrame], item: str, category: str, patterns: Iterable[str] = (MEDICATION_CATEGORY_PATTERN,)
) -> DataFrame:
    """Distinct item names of some categories over all sources, bracketed prefix removed.

    Distinct runs on the raw name, so two raw names may give the same clean name.
    """
    patterns = list(patterns)
    picked = [df.filter(any_like(F.col(category), patterns)).select(item) for df in sources]
    names = reduce(DataFrame.unionByName, picked).dropna().distinct()
    return names.withColumn(item, drop_bracket_prefix(F.col(item)))


def dictionary_table(
    dictionary: DataFrame, word: str, code: str, order: str, code_match: str = "stripped"
) -> DataFrame:
    """The dictionary as one row (path, word, code) per path.

    Words are unique by raw text, first kept, and then stripped; of two words with the
    same path (brackets in ASCII form) the later one stays. A code belongs to the last row of
    a name. `code_match='raw'` compares the stripped word with unstripped names, so
    that a name with outer blanks loses its code.
    """
    if code_match not in ("stripped", "raw"):
        raise ValueError("code_match is 'stripped' or 'raw'")
    rows = dictionary.select(F.col(word).alias("raw"), F.col(code).alias("code"), F.col(order).alias("ord")).filter(
        F.col("raw").isNotNull()
    )
    words = rows.groupBy("raw").agg(F.min("ord").alias("ord")).withColumn("word", strip_text(F.col("raw")))
    paths = words.groupBy(ascii_brackets(F.col("word")).alias("path")).agg(F.max_by("word", "ord").alias("word"))
    named = F.col("raw") if code_match == "raw" else strip_text(F.col("raw"))
    codes = rows.groupBy(named.alias("word")).agg(F.max_by("code", "ord").alias("code"))
    return paths.join(codes, "word", "left").select("path", "word", "code")


def _broadcast_walk(name: Column, table: DataFrame, suffix: str) -> Column:
    """Standardise with the whole dictionary in every Python worker (size checked before).

    Each distinct name of a batch is walked once, all of them side by side.
    """
    rows = table.toArrow()
    words = DictionaryTrie.of(rows.column("path").combine_chunks(), rows.select(["word", "code"]))
    shared = table.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(_RESULT)
    def standardise_batch(paths: pa.Array) -> pa.Array:
        known = shared.value
        named = pc.fill_null(known.values.column("word").combine_chunks(), "")
        is_word = np.append(pc.not_equal(named, "").to_numpy(zero_copy_only=False), False)
        distinct = paths.dictionary_encode()
        node = known.walked(distinct.dictionary)
        entry = known.entries(node)
        # a node without a word goes on by the suffix if the dictionary does
        longer = known.followed(node, suffix) if suffix else np.zeros(len(node), np.int64)
        entry = np.where(~is_word[entry] & (longer > 0), known.entries(longer), entry)
        found = known.values.take(pa.array(entry, mask=entry < 0)).combine_chunks()
        return pa.StructArray.from_arrays(
            [found.column(c).combine_chunks().take(distinct.indices) for c in ("word", "code")], names=["standard", "code"]
        )

    return standardise_batch(ascii_brackets(name))


def _lower_tries(table: DataFrame, most: int = LOWER_TRIE) -> DataFrame:
    """What may follow each node of the dictionary: (node, whole, next).

    A node with at most `most` nodes below has all of them in `next` (as suffixes) and is `whole`;
    any other node has the characters that follow it. So a row stays small for any dictionary.
    """
    nodes = table.select("path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("i")).select(
        F.expr("substring(path, 1, i)").alias("below")
    ).distinct()
    pairs = nodes.filter(F.length("below") > 0).select(
        "below", F.explode(F.sequence(F.lit(0), F.length("below") - 1)).alias("i")
    ).select(F.expr("substring(below, 1, i)").alias("node"), F.expr("substring(below, i + 1)").alias("suffix"))
    sizes = pairs.groupBy("node").agg((F.count(F.lit(1)) <= most).alias("whole"))
    # the root is above every node
    kept = skew_join(pairs, sizes, "node", spread_by=["suffix"]).filter(F.col("whole") | (F.length("suffix") == 1))
    return kept.groupBy("node", "whole").agg(F.collect_set("suffix").alias("next"))


def _taken(rest: Column, following: Column, whole: Column) -> Column:
    """How far the walk comes within one row: the text taken and the place of its last character."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(state: Column, ch: Column) -> Column:
        longer = F.concat(state["text"], ch)
        go = (whole | (state["text"] == "")) & F.array_contains(following, longer)
        return F.struct(
            F.when(go, longer).otherwise(state["text"]).alias("text"),
            F.when(go, state["i"] + 1).otherwise(state["at"]).alias("at"), (state["i"] + 1).alias("i"),
        )

    return F.aggregate(rest, start, step)


def walk_by_joins(names: DataFrame, table: DataFrame, suffix: str = TABLET_SUFFIX, most: int = LOWER_TRIE) -> DataFrame:
    """The same walk for a dictionary of any size: a few equi-joins.

    Each round joins the node of a name with what may follow it. Below a small node the walk
    ends within the row; at a large one it takes one character and goes on in the next round. So
    there are as many rounds as large nodes follow each other, not as words have characters.
    Every round is written to the shared folder, so that a lost executor repeats one round and
    the plan does not grow.

    `names` has one column `name` without repeats; the result is (name, standard, code).
    """
    follow = written(_lower_tries(table, most), "lower-tries")
    steps = F.sequence(F.lit(0), F.length("path"))
    nodes = table.select("path", F.explode(steps).alias("i")).select(
        F.expr("substring(path, 1, i)").alias("node")
    ).distinct()
    ends = nodes.join(table.withColumnRenamed("path", "node"), "node", "left")

    moving = names.select(
        "name", F.lit("").alias("node"), F.split(ascii_brackets(F.col("name")), "").alias("rest")
    )
    settled = []
    hot = {}  # all names begin at the root, and this round needs no look
    while True:
        first = not settled
        at_node = moving.join(F.broadcast(follow.filter("node = ''")), "node", "left") if first else skew_join(
            moving, follow, "node", "left", hot=hot, spread_by=["name"]
        )
        walked = at_node.withColumn("t", _taken(F.col("rest"), F.col("next"), F.col("whole")))
        goes_on = F.coalesce(~F.col("whole") & (F.col("t.at") > 0), F.lit(False))
        step = written(
            walked.select(
                "name", F.concat("node", F.coalesce("t.text", F.lit(""))).alias("node"), goes_on.alias("moved"),
                F.when(goes_on, F.slice("rest", F.col("t.at") + 1, F.size("rest"))).alias("rest"),
            ),
            "walk",
        )
        settled.append(step.filter(~F.col("moved")).select("name", "node"))
        moving = step.filter("moved").drop("moved")
        left, hot = key_profile(moving, "node")
        if left == 0:
            break
    reached = reduce(DataFrame.union, settled)
    longer = ends.select(F.col("node").alias("next_node"), F.col("word").alias("next_word"), F.col("code").alias("next_code"))
    # `ends` always has the root as a node when the dictionary is not empty
    found = skew_join(reached, ends, "node", "left", spread_by=["name"]).withColumn(
        "next_node", F.concat("node", F.lit(suffix))
    )
    found = skew_join(found, longer.withColumn("is_node", F.lit(True)), "next_node", "left", spread_by=["name"])
    stepped = F.col("is_node") & (F.coalesce("word", F.lit("")) == "")
    return found.select(
        "name",
        F.when(stepped, F.col("next_word")).otherwise(F.col("word")).alias("standard"),
        F.when(stepped, F.col("next_code")).otherwise(F.col("code")).alias("code"),
    )


def standardise(
    names: DataFrame,
    dictionary: DataFrame,
    *,
    name: str,
    word: str = "medical_name",
    code: str = "atc",
    order: str = "ord",
    suffix: str = TABLET_SUFFIX,
    missing: str | None = None,
    code_match: str = "stripped",
    limit: BroadcastLimit = DICTIONARY_LIMIT,
) -> DataFrame:
    """Add the dictionary word (`standard`) and its `code` to every row of `names`.

    A dictionary within `limit` is walked in Arrow batches, each distinct name of a batch
    once, without a shuffle. A larger one goes through `walk_by_joins` over distinct names.
    `missing` replaces the standard name of a NULL name; by default it stays NULL. `names` must not
    have columns `standard` and `code` of its own.
    """
    taken = {"standard", "code"} & {c.lower() for c in names.columns}
    if taken:
        raise ValueError(f"names already has {sorted(taken)}")
    # measured, collected or joined: written once, so that the dictionary is built once
    table = written(dictionary_table(dictionary, word, code, order, code_match), "dictionary")
    if fits(table, limit):
        result = names.withColumn("__s", _broadcast_walk(F.col(name), table, suffix)).select(
            *names.columns, "__s.standard", "__s.code"
        )
    else:
        distinct = names.select(F.col(name).alias("name")).dropna().distinct()
        walked = walk_by_joins(distinct, table, suffix).withColumnRenamed("name", name)
        result = skew_join(names, walked, name, "left").select(*names.columns, "standard", "code")
    if missing is not None:
        result = result.withColumn("standard", fill_missing(F.col("standard"), F.col(name), missing))
    return result


def match_ratio(standardised: DataFrame, standard: str = "standard") -> DataFrame:
    """Rows, matched rows and their ratio; the ratio of no rows is NULL."""
    hit = F.col(standard).isNotNull().cast("int")
    return standardised.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("n_matched"),
        F.avg(hit).alias("ratio"),
    )
