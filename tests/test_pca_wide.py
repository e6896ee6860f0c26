"""Components of many features, and of all embeddings, against numpy."""

import numpy as np
import pyarrow as pa
import pytest

from cohortry.operators import pca
from cohortry.plans import QUERIES


def frame(spark, x, tasks):
    return spark.createDataFrame(pa.table({"x": pa.array(list(x))})).repartition(tasks)


def decomposed(x):
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    vt *= np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    return s**2 / (s**2).sum(), vt


@pytest.fixture(scope="module")
def embeddings(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("embedding").toPandas()["embedding"]
    return decomposed(np.array(rows.tolist(), float))


def test_whole_spectrum(spark, data, embeddings):
    ratios, _ = embeddings
    rows = QUERIES["pca_spectrum"](spark, data).orderBy("component").collect()
    assert len(rows) == 64 == len(ratios)
    assert np.allclose([r.ratio for r in rows], ratios, atol=1e-6)
    assert np.allclose([r.cumulative for r in rows], np.cumsum(ratios), atol=1e-6)


def test_half_of_the_variance(spark, data, embeddings):
    ratios, _ = embeddings
    count = int(np.searchsorted(np.cumsum(ratios), 0.5, side="right")) + 1
    rows = QUERIES["pca_fraction"](spark, data).orderBy("component").collect()
    assert len(rows) == count > 10 and rows[-1].cumulative > 0.5 >= rows[-2].cumulative


def test_five_loadings(spark, data, embeddings):
    found = np.zeros((5, 64))
    for r in QUERIES["pca_loadings"](spark, data).collect():
        found[r.component - 1, r.feature] = r.loading
    assert np.allclose(found, embeddings[1][:5], atol=1e-5)


def test_features_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(pca, "BLOCK", 7)
    x = np.random.default_rng(2).normal(50, 3, (400, 30)) * np.linspace(1, 9, 30)
    df = frame(spark, x, 5)
    ratios, vt = decomposed(x)
    fitted = pca.pca_fit(df, "x")
    assert np.allclose(fitted.ratios, ratios) and np.allclose(fitted.components, vt, atol=1e-6)
    assert np.allclose(fitted.mean, x.mean(axis=0))
    cov = np.zeros((30, 30))
    rows = pca.covariance(df, "x").collect()
    for r in rows:
        cov[r.i, r.j] = cov[r.j, r.i] = r["cov"]
    assert len(rows) == 465 and np.allclose(cov, np.cov(x.T))


def test_tree_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(pca, "_few_tasks", lambda data: (data, 9))
    x = np.random.default_rng(3).normal(0, 1, (300, 6)) * np.arange(1, 7)
    fitted = pca.pca_fit(frame(spark, x, 40), "x", 3)
    assert np.allclose(fitted.ratios, decomposed(x)[0][:3])


def test_four_thousand_features(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(0, 1, (200, 12)) * np.geomspace(40, 2, 12) @ draw.normal(0, 1, (12, 4096)) + draw.normal(7, 1, (200, 4096))
    ratios, vt = decomposed(x)
    df = frame(spark, x, 6).persist()
    whole = pca.pca_fit(df, "x", 6)
    assert np.allclose(whole.ratios, ratios[:6]) and np.allclose(np.abs((whole.components * vt[:6]).sum(1)), 1, atol=1e-6)
    found = pca.pca_fit(df, "x", 6, widest=1000)
    assert np.allclose(found.ratios, ratios[:6], rtol=1e-4) and np.allclose(found.mean, x.mean(axis=0))
    assert np.allclose(np.abs((found.components * vt[:6]).sum(1)), 1, atol=1e-4)
    assert np.allclose(found.components @ found.components.T, np.eye(6), atol=1e-9)
    for wrong in (None, 0.5, 0, 1000):
        with pytest.raises(ValueError):
            pca.pca_fit(df, "x", wrong, widest=1000)
    scores = pca.pca_scores(df, found, "x", []).toPandas().to_numpy()
    assert np.allclose(np.sort(scores.var(axis=0, ddof=0))[::-1] * 200 / ((x - x.mean(0)) ** 2).sum(), ratios[:6], rtol=1e-3)
    df.unpersist()


def test_shuffled_rows_do_not_grow_with_the_partitions(spark):
    """Blocks a task hands on depend on the cores."""
    x = np.random.default_rng(4).normal(0, 1, (500, 4))
    cores = spark.sparkContext.defaultParallelism
    for tasks in (3, 200):
        few, _ = pca._few_tasks(frame(spark, x, tasks))
        assert few.rdd.getNumPartitions() <= 2 * cores


def test_vectors_of_different_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "x array<double>")
    with pytest.raises(Exception, match="differ in length"):
        pca.pca_fit(df, "x", 1)
