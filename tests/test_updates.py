"""Updates of stored tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cohortry.sources import updates
from cohortry.sources.updates import Updated, update_in_place


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 10 = 9 THEN NULL ELSE id % 10 END AS part", "CASE WHEN id % 100 IN (13, 19) THEN NULL ELSE 'x' END AS code",
        "date_add(DATE'2020-01-01', int(id)) AS day",
    )
    rows.write.partitionBy("part").parquet(path)
    return path


def fill(df):
    return df.withColumn("changed", F.col("code").isNull()).withColumn("code", F.coalesce("code", F.concat(F.lit("new "), F.col("id").cast("string"))))


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("listed", [256, 0])
def test_only_touched_partitions_are_written(spark, table, monkeypatch, listed):
    monkeypatch.setattr(updates, "LISTED", listed)
    before = files(table)
    assert update_in_place(spark, table, fill, ["part"]) == Updated(20, 200, 2)
    after = files(table)
    touched = ("part=3/", "part=__HIVE_DEFAULT_PARTITION__/")
    assert {f: t for f, t in before.items() if not f.startswith(touched)} == {f: t for f, t in after.items() if not f.startswith(touched)}
    assert not {f for f in before if f.startswith(touched)} & set(after)
    rows = spark.read.parquet(table)
    assert rows.count() == 1000 and rows.filter("code IS NULL").count() == 0
    assert {r.code for r in rows.filter("code != 'x'").collect()} == {f"new {i}" for i in range(1000) if i % 100 in (13, 19)}
    assert rows.filter("part IS NULL").count() == 100
    # a second run finds nothing to do
    assert update_in_place(spark, table, fill, ["part"]) == Updated(0, 0, 0)
    assert files(table) == after


def test_an_update_must_keep_rows_and_columns(spark, table):
    before = files(table)
    with pytest.raises(ValueError, match="rows"):
        update_in_place(spark, table, lambda df: fill(df).filter("id != 13"), ["part"])
    with pytest.raises(ValueError, match="day"):
        update_in_place(spark, table, lambda df: fill(df).drop("day"), ["part"])
    with pytest.raises(ValueError, match="changed"):
        update_in_place(spark, table, lambda df: df, ["part"])
    with pytest.raises(ValueError, match="partitioned"):
        update_in_place(spark, table, fill, ["nothing"])
    assert files(table) == before


def test_types_stay(spark, table):
    schema = spark.read.parquet(table).schema
    update_in_place(spark, table, lambda df: fill(df).withColumn("id", F.col("id").cast("decimal(20,0)")), ["part"])
    assert spark.read.parquet(table).schema == schema


def test_unpublished_staging_changes_nothing(spark, table, monkeypatch):
    """A run that ends before the staged rows are published leaves the table as it was; the next one does all of it."""
    before = files(table)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(updates, "delete_folder", lost)
    with pytest.raises(RuntimeError):
        update_in_place(spark, table, lambda df: fill(df).filter("id != 13"), ["part"])
    assert files(table) == before
    monkeypatch.undo()
    assert update_in_place(spark, table, fill, ["part"]) == Updated(20, 200, 2)
