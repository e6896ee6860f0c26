"""Many equal rows and texts: the work grows with the rows, not with their square or cube."""

import time

import pytest
from brute import substrings

from cohortry.llm import substring_dedup

WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("ids", ["missing", "one", "different"])
def test_five_thousand_equal_rows(spark, ids):
    name = {"missing": "CAST(NULL AS bigint)", "one": "CAST(7 AS bigint)", "different": "id"}[ids]
    frame = spark.range(5000).selectExpr(f"{name} AS doc_id", f"'{WORDS}' AS text")
    other = spark.createDataFrame([(-1, "alone " + WORDS[:60]), (-2, "x " * 40), (-3, WORDS + " end")], "doc_id bigint, text string")
    start = time.time()
    rows = substring_dedup.without_repeats(frame.union(other)).collect()
    assert time.time() - start < 60
    found = sorted({tuple(r) for r in rows if r["doc_id"] is None or r["doc_id"] in (-1, -2, -3, 7, 4999)}, key=str)
    few = [(d, WORDS) for d in {"missing": [None] * 2, "one": [7] * 2, "different": [7, 4999]}[ids]]
    want = substrings([*few, *[tuple(r) for r in other.collect()]], 35)
    assert len(rows) == 5003 and found == sorted(set(want), key=str)
