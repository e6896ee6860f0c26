"""Vector codes against k-means by all distances in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortry.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=4096):
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[math.floor(scale * float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(vectors[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in vectors]
    book = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            far = [[sum((x - y) ** 2 for x, y in zip(v[p], c)) for c in book[p]] for p in range(parts)]
            out.append([(min(range(len(f)), key=lambda k: (f[k], k)), min(f)) for f in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(book[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][0] == k]
                if own:
                    book[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    of_label = {}
    for r, e in zip(kept, errors):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{k:02x}" for k, _ in f), e, of_label[r[2]], digest) for r, f, e in zip(kept, found, errors)), key=str
    )


def random_rows(n, length, seed, grid=None):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.4) for _ in range(length)] for _ in range(6)]
    out = []
    for i in range(n):
        v = [x + draw.gauss(0, 0.1) for x in draw.choice(centres)]
        if grid:  # many equal distances
            v = [round(x * grid) / grid for x in v]
        out.append((i * 3 + 1, [float(np.float32(x)) for x in v], draw.choice([None, 1, 2, 3])))
    return out


@pytest.mark.parametrize("grid", [None, 2, 1])
@pytest.mark.parametrize("entries", [1, 5, 16])
def test_same_as_all_distances(spark, grid, entries):
    rows = random_rows(150, 12, 7 * entries, grid)
    rows += [rows[3], (5000, rows[4][1], 2), (None, rows[0][1], None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vector_codes.coded_vectors(frame, parts=3, entries=entries, rounds=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 3, entries, 4)


def test_balls_give_the_assignment_of_all_distances_from_any_start():
    draw = np.random.default_rng(5)
    for reach in (3, 40, 100_000):
        points = draw.integers(-reach, reach, (3000, 4))
        entries = draw.integers(-reach, reach, (16, 4))
        entries[7] = entries[2]
        want = vector_codes.nearest(points, entries)
        for ball in (want[0], draw.integers(0, 16, 3000), np.full(3000, 11)):
            got = vector_codes.moved(points, entries, ball)
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_stable_parts_are_not_compared(monkeypatch):
    """Parts in the core of their ball meet their own entry only."""
    entries = np.array([[0, 0], [1000, 0], [0, 1000]])
    draw = np.random.default_rng(1)
    ball = draw.integers(0, 3, 600)
    points = entries[ball] + draw.integers(-9, 9, (600, 2))
    met = []
    real = vector_codes._squared
    monkeypatch.setattr(vector_codes, "_squared", lambda p, e: met.append(len(p)) or real(p, e))
    vector_codes.moved(points, entries, ball)
    assert met == [600]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = random_rows(20, 6, 3)
    odd = [(901, None, 1), (902, [nan] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [inf] * 6, 1), (905, [1.0, 2.0], 1), (906, [1e30] * 6, 1)]
    frame = spark.createDataFrame(good + odd, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "'x' AS codes")
    got = sorted((tuple(r) for r in vector_codes.coded_vectors(frame, parts=2).collect()), key=str)
    assert got == plain(good, 2, 16, 6)
    whole, book = vector_codes.encoded(frame, parts=2)
    assert whole.columns == ["vec_id", "embedding", "label", "code", "codes", "error"] and book.shape == (2, 16, 3)
    for rows in ([], odd[:3]):
        assert vector_codes.coded_vectors(spark.createDataFrame(rows, SCHEMA)).count() == 0
    # 8 parts of 6 components end in zeros
    padded = vector_codes.coded_vectors(spark.createDataFrame(good, SCHEMA)).collect()
    assert {len(r["code"]) for r in padded} == {16} and len(padded) == 20


def test_codes_stand_for_vectors(spark):
    rows = random_rows(300, 8, 9)
    found, book = vector_codes.encoded(spark.createDataFrame(rows, SCHEMA), parts=4)
    table = found.toArrow()
    codes = np.array([list(c) for c in table["codes"].to_pylist()])
    near = vector_codes.decoded(codes, book, 8)
    true = np.array(table["embedding"].to_pylist())
    assert np.abs(near - true).mean() < np.abs(true - true.mean(0)).mean() / 2
