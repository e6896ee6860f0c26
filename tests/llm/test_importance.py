"""Importance resampling against a plain version, document by document."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from brute import LETTERED, low

from cohortry.llm import importance


def plain_features(text, longest):
    """All sequences of the whole text, with no regard to lines."""
    words = LETTERED.findall(low(text))
    return words, Counter(" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))


def plain(rows, aims, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def total(texts):
        out = Counter()
        for t in texts:
            for f, n in plain_features(t, longest)[1].items():
                out[zlib.crc32(f.encode()) % buckets] += n
        return out

    s, t = total(x for _, x in rows), total(aims)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        words, features = plain_features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] * n for f, n in features.items())
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, sum(features.values()), weight, score, None, len(words)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for i, r in enumerate(eligible[:percent * len(eligible) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture
def rows(texts):
    lined = [t.replace(" beta ", "\n").replace(" x ", "\n\n \n") for t in texts]
    out = list(enumerate(lined)) + [(1000, None), (1001, ""), (1002, "\n \n"), (None, lined[-1]), (3, lined[3]), (3, lined[3]), (3, "word " * 30)]
    return out + [(2000, "\n".join(["the same line of words"] * 300 + ["É ß 漢字"])), (2001, "alpha " * 5000)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_same_as_plain(spark, documents, rows, longest):
    aims = ["alpha kappa mu\n42 alpha", None, "theta delta\n\nx", "zeta"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id int, text string")
    got = importance.resampled(documents(rows, extra=True), target, longest=longest, buckets=512, percent=30)
    assert result(got) == plain(rows, aims, longest, 512, 30)


def test_line_of_a_third_of_all_rows(spark, documents):
    """Lines on most places are broadcast, the others are not, and ranks have no gaps."""
    rows = [(i, ("one very common line of words\n" if i % 3 else "") + " ".join(f"w{i % 50}x{k}" for k in range(25))) for i in range(2000)]
    target = spark.createDataFrame([(0, "w3x1 w4x1 common")], "item_id int, text string")
    got = importance.resampled(documents(rows), target)
    assert result(got) == plain(rows, ["w3x1 w4x1 common"])
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 201))


def test_only_distinct_lines_are_split(spark, documents):
    frame = documents([(i, "a line\nanother line\na line") for i in range(50)])
    counted = importance.counted_lines(frame, 1, 100).collect()
    assert sorted(r["places"] for r in counted) == [50, 100]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    assert importance.resampled(documents([]), none).count() == 0
    rows = [(i, f"some words of text {i} " * 10) for i in range(20)]
    assert result(importance.resampled(documents(rows), none)) == plain(rows, [])
