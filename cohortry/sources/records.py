"""Rows from anything that answers statements with a cursor: names from its description, rows in batches.

The connection is opened in the tasks, one for each set of arguments, so a large answer is read by many tasks and
nothing passes the driver. It suits drivers of the usual Python interface for databases (`connect()`, `cursor()`,
`execute(statement, args)`, `description`, `fetchmany(n)`), where Spark has no reader of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FETCHED = 10_000


def described_rows(cursor: Any, fetch: int = FETCHED) -> Iterator[tuple[list[str], list[Sequence]]]:
    """The column names and rows of an answer, `fetch` rows at a time."""
    names = [column[0] for column in cursor.description]
    while rows := cursor.fetchmany(fetch):
        yield names, rows


class _Part(InputPartition):
    def __init__(self, args: Sequence | dict | None):
        self.args = args


def read_records(
    spark: SparkSession, connect: Callable[[], Any], statement: str, schema: StructType | str,
    args: Sequence[Sequence | dict | None] = (None,), fetch: int = FETCHED,
) -> DataFrame:
    """The rows of `statement`, once for each set of arguments in `args`, each read by a task of its own.

    `connect` runs in the tasks and must be usable there (a function that imports what it needs). Columns are taken by
    name from the answer's description, which must have all columns of `schema`, in any order and whatever their case.
    A task that is repeated runs its statement again.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = [_Part(a) for a in args]

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return parts

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            connection = connect()
            try:
                cursor = connection.cursor()
                try:
                    cursor.execute(statement, *([] if partition.args is None else [partition.args]))
                    for names, rows in described_rows(cursor, fetch):
                        yield _batch(names, rows, wanted)
                finally:
                    cursor.close()
            finally:
                connection.close()

    class Records(DataSource):
        @classmethod
        def name(cls) -> str:
            return "described_records"

        def schema(self) -> StructType:
            return wanted

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Records)
    return spark.read.format("described_records").load()


def _batch(names: list[str], rows: list[Sequence], wanted: StructType) -> pa.RecordBatch:
    place = {name.lower(): i for i, name in enumerate(names)}
    missing = [f.name for f in wanted.fields if f.name.lower() not in place]
    if missing:
        raise ValueError(f"the answer has no columns {missing}")
    arrow = to_arrow_schema(wanted)
    columns = [pa.array([row[place[field.name.lower()]] for row in rows], field.type) for field in arrow]
    return pa.record_batch(columns, schema=arrow)
