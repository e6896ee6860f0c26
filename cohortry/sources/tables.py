"""Reading and writing tables: parquet, CSV, SQL text and JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DICTIONARY_SCHEMA = T.StructType(
    [T.StructField("medical_name", T.StringType()), T.StructField("atc", T.StringType())]
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; the files carry the schema."""
    return spark.read.parquet(path)


# A quote inside quotes is doubled, and a backslash is a character like any other.
_QUOTES = {"quote": '"', "escape": '"'}
BYTE_ORDER_MARK = "\ufeff"


# Rows are judged by all their fields, whichever of them a query asks for.
_MISFIT = "__misfit"
_CHECKED = {"columnPruning": False}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, order: str | None = None, line_breaks: bool = False, strict: bool = False
) -> DataFrame:
    """A CSV file with a header, read with a given schema. A byte-order mark is ignored.

    `line_breaks` allows line breaks inside quotes; a file is then read by one task. `order` adds a sortable column with the position of the row in the file (file, block and
    row), for tables in which the first or last of several rows counts. `strict` makes the read fail at a row that does not
    fit the schema; without it such a row is cut or filled with NULL. `read_csv_checked` sets these rows apart.
    """
    options = {**_CHECKED, "mode": "FAILFAST"} if strict else {}
    return _ordered(_csv_rows(spark, path, schema, line_breaks, **options), order)


def _csv_rows(spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool, **options) -> DataFrame:
    known = {"header": True, "encoding": "UTF-8", "enforceSchema": False, "multiLine": line_breaks, **_QUOTES}
    return spark.read.schema(schema).options(**known, **options).csv(path)


def _ordered(rows: DataFrame, order: str | None) -> DataFrame:
    if order is None:
        return rows
    # rows of one block are numbered in file order by one task; blocks are ordered by offset
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select("*", position.alias(order))


@dataclass(frozen=True)
class CheckedRows:
    """Rows that fit the schema, and the others as (file, text).

    `counts()` gives rows and misfits once an action over `fitting` has run: it counts them on its way.
    """

    fitting: DataFrame
    misfits: DataFrame
    seen: Observation

    def counts(self) -> tuple[int, int]:
        return self.seen.get["n_rows"], self.seen.get["n_misfits"]


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, order: str | None = None, line_breaks: bool = False
) -> CheckedRows:
    """As `read_csv`, with the rows set apart that have too few or too many fields, or a field of another type.

    A quote that is not closed is no misfit: it ends with its line (or, with `line_breaks`, with the file).
    """
    wide = T.StructType([*schema.fields, T.StructField(_MISFIT, T.StringType())])
    rows = _csv_rows(spark, path, wide, line_breaks, **_CHECKED, mode="PERMISSIVE", columnNameOfCorruptRecord=_MISFIT)
    # Spark refuses to read nothing but the misfits, so their text is compared with the fields, which it never equals
    fields = F.concat(F.lit("\0"), F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields])))
    text = F.nullif(F.col(_MISFIT), fields)
    seen = Observation()
    numbered = _ordered(rows, order).observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(text.isNotNull()).alias("n_misfits"))
    fitting = numbered.filter(text.isNull()).drop(_MISFIT)
    misfits = rows.select(F.col("_metadata.file_path").alias("file"), text.alias("text")).filter("text IS NOT NULL")
    return CheckedRows(fitting, misfits, seen)


def read_dictionary(
    spark: SparkSession, path: str, schema: T.StructType = DICTIONARY_SCHEMA, line_breaks: bool = False
) -> DataFrame:
    """The drug dictionary (name, code) with its file order in `ord`."""
    return read_csv(spark, path, schema, order="ord", line_breaks=line_breaks)


def query(spark: SparkSession, text: str, args: Mapping | Sequence | None = None, **tables: DataFrame) -> DataFrame:
    """SQL text with bound arguments; `{name}` in the text refers to a given DataFrame."""
    return spark.sql(text, args=args, **tables)


def first_row(df: DataFrame, *order: str | Column) -> DataFrame:
    """The first row in a stated order; without an order "first" has no meaning."""
    if not order:
        raise ValueError("first_row needs an order")
    return df.orderBy(*order).limit(1)


def jdbc_options(
    url: str,
    *,
    table: str | None = None,
    sql: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition: tuple[str, object, object, int] | None = None,
    push_filters: bool = True,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Options of the JDBC source.

    `partition` is (column, lower, upper, partitions) and splits the read over executors; Spark
    allows it with `table` only, and a query can be given as a `(select ...) t` table.
    Switch `push_filters` off for a server that ignores case: simple LIKE patterns
    would be evaluated there and others in Spark.
    """
    if (table is None) == (sql is None):
        raise ValueError("give either a table or a query")
    if sql is not None and partition is not None:
        raise ValueError("a partitioned read needs a table, for a query write '(select ...) t'")
    options = {
        "url": url,
        "preferTimestampNTZ": "true",
        "pushDownPredicate": str(push_filters).lower(),
        "fetchsize": str(fetch_rows),
    }
    options["dbtable" if sql is None else "query"] = table if sql is None else sql
    options.update({k: v for k, v in (("user", user), ("password", password), ("driver", driver)) if v is not None})
    if partition is not None:
        column, low, high, n = partition
        options.update(
            {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
        )
    return options


def read_jdbc(spark: SparkSession, url: str, **options) -> DataFrame:
    """A table or query of a relational server, see `jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> int:
    """Write rows to a server table in batches and return how many were written.

    A task that is run again after a lost executor repeats its batches, so write into a
    staging table and let the server merge it.
    """
    settings = jdbc_options(url, table=table, **options)
    return _counted(df, lambda d: d.write.format("jdbc").mode(mode).options(**settings).save())


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> int:
    """Write parquet and return the number of rows, counted by the write itself."""
    return _counted(df, lambda d: d.write.mode(mode).partitionBy(*partition_by).parquet(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = False) -> int:
    """Write UTF-8 CSV with a header and return the number of rows.

    `mark` puts a byte-order mark in front of every file, which some spreadsheets need.
    """
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    return _counted(df, lambda d: d.write.mode(mode).options(header=True, encoding="UTF-8", **_QUOTES).csv(path))


def _counted(df: DataFrame, write) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]
