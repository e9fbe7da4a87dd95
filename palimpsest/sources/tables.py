"""Reading and writing tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None, snapshot: int | None = None) -> DataFrame:
    """A table of the catalog; where the name is a path, the newest (or the given) snapshot of a written table, or a Parquet folder."""
    if "/" not in name:
        return spark.table(name)
    if snapshots.is_snapshot_table(spark, name):
        return snapshots.read(spark, name, snapshot)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(name)


def read_sql(spark: SparkSession, query: str, args: dict[str, Any] | list | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised SELECT; tables are referred to as {name}."""
    return spark.sql(query, args=args, **tables) if tables else spark.sql(query, args=args)


def fetch_one(spark: SparkSession, query: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    return read_sql(spark, query, args, **tables).limit(1)


def jdbc_options(url: str, table: str, column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 1, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read; a split column needs its bounds."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partitions > 1:
        if column is None or bounds is None:
            raise ValueError("a parallel read needs a column and its bounds")
        out |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_jdbc(spark: SparkSession, *args: Any, **options: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(*args, **options)).load()


def jdbc_predicates(spark: SparkSession, url: str, table: str, column: str, partitions: int, accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a table into about equal parts by the quantiles of a column: each row meets exactly one.

    One pass over the column alone. A value that fills a part has it for itself, and so have nulls.
    """
    values = read_jdbc(spark, url, f"(SELECT {column} FROM {table}) t").toDF("v")
    kind = values.schema["v"].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{column} is no number")
    fine, nulls = values.agg(F.percentile_approx("v", [k / (4 * partitions) for k in range(1, 4 * partitions)], accuracy), F.count(F.when(F.col("v").isNull(), 1))).first()
    fine = fine or []
    often = sorted(v for v, n in Counter(fine).items() if n >= 4) if partitions > 1 else []
    edges = sorted({*fine[3::4], *often})
    out = []
    for low, high in zip([None, *edges], [*edges, None]):
        ends = [f"{column} >= {low}" if low not in often else f"{column} > {low}"] if low is not None else []
        ends += [f"{column} < {high}"] if high is not None else []
        out.append(" AND ".join(ends) or f"{column} IS NOT NULL")
    out += [f"{column} = {v}" for v in often]
    return out + [f"{column} IS NULL"] * (nulls > 0)


def read_jdbc_parts(spark: SparkSession, url: str, table: str, column: str, partitions: int, fetch_size: int = 10_000) -> DataFrame:
    """Read a table in parts of about equal size, one task each, without being told the column's bounds."""
    predicates = jdbc_predicates(spark, url, table, column, partitions)
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": str(fetch_size)})


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 1_000, **properties: str) -> None:
    """Insert rows in batches, a connection for each task."""
    df.write.mode(mode).jdbc(url, table, properties={"batchsize": str(batch_size), **properties})


def bulk_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Append rows to a table: the number of its new snapshot. Appends of several writers all stay."""
    return snapshots.append(df, path, partition_by)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), since: int | None = None) -> int:
    """Replace a table, or with partition columns those partitions that df has, in one step: the number of its new snapshot.

    df may read the table itself; `since` makes sure that nobody has written in between. Readers see the rows before or
    after, and what they began with stays until `snapshots.vacuum`.
    """
    return snapshots.overwrite(df, path, partition_by, since)


def written(df: DataFrame, path: str) -> DataFrame:
    """df, computed once into a folder that all executors share, and read from there: whoever reads it again scans, and a lost executor loses nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Versions as a table of the catalog that jobs on the record id need not shuffle: bucketed and sorted by it, open rows in a partition of their own.

    Joins and applies shuffle only what meets the table, into as many partitions as it has buckets. `is_open` tells
    the operators that the partition is there: what needs open rows only reads no others.
    """
    rows = df.withColumn("is_open", F.col("valid_to").isNull()).repartition(buckets, key)
    rows.write.mode("overwrite").partitionBy("is_open").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
