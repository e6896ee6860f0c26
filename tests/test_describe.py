"""Histograms and components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators.describe import distinct_labels, histogram, shape
from cohortry.operators.pca import covariance, pca_fit, pca_scores


@pytest.mark.parametrize("values, bins", [
    (list(range(11)), 10),
    ([0.1 * i for i in range(50)], 7),
    ([5.0] * 4, 10),
    ([-3.5, 2.25, 2.25, 9.0], 3),
    (list(np.random.default_rng(3).normal(size=2000)), 13),
])
def test_histogram_like_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    rows = histogram(df, F.col("v"), bins).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(values, dtype=float), bins)
    assert [r.n for r in rows] == list(counts)
    assert np.allclose([r.lo for r in rows] + [rows[-1].hi], edges)


def test_histogram_of_nothing_and_weights(spark):
    df = spark.createDataFrame([(None, 1)], "v double, w int")
    assert [tuple(r)[1:] for r in histogram(df, F.col("v"), 2).orderBy("bin").collect()] == [(0.0, 0.5, 0), (0.5, 1.0, 0)]
    df = spark.createDataFrame([(0.0, 3), (1.0, 4)], "v double, w int")
    assert [r.n for r in histogram(df, F.col("v"), 2, F.col("w")).orderBy("bin").collect()] == [3, 4]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 100.0
    rows = [(i, int(i % 17), [float(v) for v in row]) for i, row in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, label int, x array<double>")


def reference(x):
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    return centred, vt, s**2 / (s**2).sum()


def test_components_and_ratios(matrix):
    x, df = matrix
    _, vt, ratios = reference(x)
    fitted = pca_fit(df, "x")
    assert np.allclose(fitted.ratios, ratios)
    assert np.allclose(np.abs((fitted.components * vt).sum(axis=1)), 1.0)
    assert all(row[np.abs(row).argmax()] > 0 for row in fitted.components)


def test_number_of_components(spark, matrix):
    x, df = matrix
    _, _, ratios = reference(x)
    k = int(np.searchsorted(np.cumsum(ratios), 0.8, side="right")) + 1
    assert len(pca_fit(df, "x", 0.8).ratios) == k
    assert np.allclose(pca_fit(df, "x", 2).ratios, ratios[:2])
    assert len(pca_fit(df.limit(4), "x").ratios) == 4
    for wrong in (0, 7, 1.5, -0.5):
        with pytest.raises(ValueError):
            pca_fit(df, "x", wrong)


def test_scores_are_centred_and_keep_all_labels(matrix):
    x, df = matrix
    centred, _, _ = reference(x)
    fitted = pca_fit(df, "x", 2)
    rows = pca_scores(df, fitted, "x", ["id", "label"]).orderBy("id").collect()
    assert np.allclose([[r.pc1, r.pc2] for r in rows], centred @ fitted.components.T)
    assert len({r.label for r in rows}) == 17
    assert [r.label for r in distinct_labels(df, "label").collect()] == list(range(17))


def test_covariance(matrix):
    x, df = matrix
    found = np.zeros((6, 6))
    for r in covariance(df.repartition(5), "x").collect():
        found[r.i, r.j] = found[r.j, r.i] = r["cov"]
    assert np.allclose(found, np.cov(x.T))


def test_rows_without_features(spark, matrix):
    x, df = matrix
    odd = [(900, 1, None), (901, 1, [None] * 6), (902, 1, [float("nan")] * 6), (903, 1, [float("inf")] * 6)]
    whole = df.unionByName(spark.createDataFrame(odd, df.schema))
    plain, fitted = pca_fit(df, "x", 3), pca_fit(whole, "x", 3)
    assert np.allclose(plain.components, fitted.components) and np.allclose(plain.ratios, fitted.ratios)
    rows = pca_scores(whole, fitted, "x", ["id"]).filter("id >= 900").collect()
    assert len(rows) == 4 and all(r.pc1 is None and r.pc3 is None for r in rows)
    assert covariance(whole, "x").count() == 21
    with pytest.raises(ValueError):
        pca_fit(df.limit(0), "x", 1)
    assert len(pca_fit(df.limit(0), "x").ratios) == 0


def test_vectors_of_the_machine_learning_package(matrix):
    from pyspark.ml.functions import array_to_vector

    _, df = matrix
    vectors = df.withColumn("x", array_to_vector("x"))
    assert np.allclose(pca_fit(vectors, "x", 2).components, pca_fit(df, "x", 2).components)


def test_shape(matrix):
    row = shape(matrix[1]).first()
    assert (row.n_rows, row.n_columns, row.columns) == (300, 3, ["id", "label", "x"])
