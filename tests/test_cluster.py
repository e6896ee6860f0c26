"""Queries that write intermediate tables, on executors that are not the driver."""

import os
import subprocess
import sys

import pytest
from compare import spark_result, sql_result, tables

from cohortry.plans import SQL

HERE = os.path.dirname(os.path.abspath(__file__))
NAMES = [
    "age_histogram",
    "attrition",
    "bucketed_first_occurrence",
    "cohort",
    "bucketed_after_index",
    "cohort_label_counts",
    "cohort_of_frames",
    "cohort_members",
    "cohort_shared_records",
    "csv_bad_rows",
    "combine_first",
    "csv_round_trip",
    "fill_by_automata",
    "excluded_shared_records",
    "fill_by_automaton",
    "index_with_outcome",
    "follow_up_histogram",
    "index_without_outcome",
    "last_contact_without_outcome",
    "last_contact",
    "match_ratio",
    "name_chain_changed",
    "outcome_first",
    "name_chain",
]


@pytest.fixture(scope="module")
def results(data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("cluster"))
    env = os.environ | {"PYTHONPATH": os.path.dirname(HERE), "PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, f"{HERE}/cluster_run.py", data, out, *NAMES], env=env, cwd=out, timeout=600, check=True)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_with_a_plain_checkpoint_path(spark, data, results, name):
    if os.path.exists(f"{results}/{name}.failed"):
        with open(f"{results}/{name}.failed") as f:
            pytest.fail(f.read()[:2000])
    assert spark_result(spark.read.parquet(f"{results}/{name}")) == sql_result(tables(data), SQL[name])
