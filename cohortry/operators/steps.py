"""Counts after every step of a selection, from one run of it.

A step does not drop rows: it marks how far each row came. So the whole chain is computed once, in the write of
its rows, and that write counts the rows of every step on its way (`observe`). Persons of every step come
from the two columns (person, steps taken) of the written table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import written
from .skew import skew_join

_TAKEN, _KEY = "__taken", "__known_key"


class Steps:
    """A chain of selections over one frame, each with a name.

    Every method adds a step and returns a new chain; `done` runs it. Conditions that are NULL do not hold.
    """

    def __init__(self, frame: DataFrame, person: str, name: str):
        self._frame = frame.withColumn(_TAKEN, F.lit(1))
        self._person, self._names, self._columns = person, [name], frame.columns

    def _next(self, name: str, frame: DataFrame, condition: Column) -> Steps:
        out = Steps.__new__(Steps)
        out._person, out._names, out._columns = self._person, [*self._names, name], self._columns
        goes_on = (F.col(_TAKEN) == len(self._names)) & F.coalesce(condition, F.lit(False))
        columns = [F.col(f"`{c}`") for c in self._columns]
        out._frame = frame.select(*columns, (F.col(_TAKEN) + goes_on.cast("int")).alias(_TAKEN))
        return out

    def keep(self, name: str, condition: Column) -> Steps:
        """Rows that satisfy a condition."""
        return self._next(name, self._frame, condition)

    def with_keys(self, name: str, keys: DataFrame, spread_by: Sequence[str] = ()) -> Steps:
        """Rows of the persons in `keys`."""
        return self._next(name, self._flagged(keys, spread_by), F.col(_KEY))

    def without_keys(self, name: str, keys: DataFrame, spread_by: Sequence[str] = ()) -> Steps:
        """Rows of the persons that are not in `keys`; a missing person is in no table of keys."""
        return self._next(name, self._flagged(keys, spread_by), F.col(_KEY).isNull())

    def _flagged(self, keys: DataFrame, spread_by: Sequence[str]) -> DataFrame:
        known = keys.select(self._person).dropna().distinct().withColumn(_KEY, F.lit(True))
        return skew_join(self._frame, known, self._person, "left", spread_by=spread_by)

    def drop_keys_where(self, name: str, condition: Column, spread_by: Sequence[str] = ()) -> Steps:
        """All rows of a person are out as soon as a remaining one satisfies the condition.

        This needs the rows so far twice, so they are written here, and the chain goes on from the table.
        """
        frame = written(self._frame, "steps")
        left = F.col(_TAKEN) == len(self._names)
        bad = frame.filter(left & condition).select(self._person)
        cut = Steps.__new__(Steps)
        cut._person, cut._names, cut._columns, cut._frame = self._person, self._names, self._columns, frame
        return cut.without_keys(name, bad, spread_by)

    def done(self) -> tuple[DataFrame, DataFrame]:
        """The rows that took all steps, and (step_no, step, n_rows, n_persons)."""
        seen, numbers = Observation(), range(1, len(self._names) + 1)
        counted = self._frame.observe(seen, *[F.count_if(F.col(_TAKEN) >= i).alias(f"n{i}") for i in numbers])
        table = written(counted, "steps")
        n_rows = [seen.get[f"n{i}"] for i in numbers]
        farthest = table.dropna(subset=[self._person]).groupBy(self._person).agg(F.max(_TAKEN).alias(_TAKEN))
        steps = [
            F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.lit(n).cast("bigint").alias("n_rows"), F.count_if(F.col(_TAKEN) >= i).alias("n_persons"))
            for i, name, n in zip(numbers, self._names, n_rows, strict=True)
        ]
        report = farthest.agg(F.array(*steps).alias("steps")).select(F.inline("steps"))
        return table.filter(F.col(_TAKEN) == len(self._names)).drop(_TAKEN), report
