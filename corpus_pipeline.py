"""A training-data pipeline: each stage calls one operator and decides about all rows it gets."""

from __future__ import annotations

from cohortry.llm.stages import STAGES, run

# SQL has neither suffix automata nor byte-pair merges; tests/llm compares the pipeline with a
# brute-force version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
