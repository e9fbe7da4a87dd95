"""Object stores as tables: inventory, metadata and byte chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE_CAR = ".meta.json"


def _files(spark: SparkSession, root: str) -> DataFrame:
    # Hadoop may write the scheme with one or three slashes.
    bare = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    key = F.regexp_replace(F.substr(F.col("path"), F.locate(f"{bare}/", F.col("path")) + F.lit(len(bare) + 1)), "^/+", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("key", key)


def object_inventory(spark: SparkSession, root: str, prefix: str = "", limit: int | None = 1000) -> DataFrame:
    """(key, size, modified) of objects whose key starts with the prefix, by key; contents are not read.

    Spark's file sources skip empty files, so empty objects are not listed.
    """
    out = _files(spark, root).where(~F.col("key").endswith(SIDE_CAR) & F.col("key").startswith(prefix)).select("key", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if limit is None else out.orderBy("key").limit(limit)


def object_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(key, metadata) of every object; without a side-car the map is empty."""
    files = _files(spark, root)
    cars = files.where(F.col("key").endswith(SIDE_CAR)).select(
        F.expr(f"left(key, length(key) - {len(SIDE_CAR)})").alias("key"), F.from_json(F.decode("content", "utf-8"), "map<string,string>").alias("metadata")
    )
    return files.where(~F.col("key").endswith(SIDE_CAR)).select("key").join(cars, "key", "left").select("key", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def object_chunks(spark: SparkSession, root: str, chunk_size: int = 8192, range_size: int = 64 << 20) -> DataFrame:
    """(key, chunk, bytes) of all objects; an empty object has none.

    An object is cut into ranges of about range_size bytes, and a task reads its ranges through Arrow's file systems (local, hdfs,
    s3, gs), chunk by chunk: a large object is read by many tasks, and none holds more than a batch of chunks.
    """
    per_range = max(range_size // chunk_size, 1) * chunk_size
    files = _files(spark, root).where(~F.col("key").endswith(SIDE_CAR) & (F.col("length") > 0)).select("key", "path", "length")
    starts = files.withColumn("start", F.explode(F.expr(f"sequence(0L, length - 1, {per_range}L)")))
    dealt = starts.withColumn("stop", F.least(F.col("start") + per_range, F.col("length"))).repartition(_tasks(spark, root, per_range), "key", "start")
    return dealt.select("key", "path", "start", "stop").mapInArrow(_ranges(chunk_size), "key string, chunk int, bytes binary")


def _tasks(spark: SparkSession, root: str, range_size: int) -> int:
    """As many tasks as there are ranges, but not more than a few for each core."""
    ranges = _files(spark, root).agg(F.sum(F.ceil(F.col("length") / range_size))).first()[0]
    return max(1, min(int(ranges or 1), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _ranges(chunk_size: int, batch_bytes: int = 4 << 20):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(_uri(row["path"]))
                with store.open_input_file(path) as source:
                    source.seek(row["start"])
                    at = row["start"]
                    while at < row["stop"]:
                        step = min(max(batch_bytes // chunk_size, 1) * chunk_size, row["stop"] - at)
                        data = source.read(step)
                        if len(data) != step:
                            raise OSError(f"{row['path']} ends before byte {at + step}")
                        cut = [data[i : i + chunk_size] for i in range(0, step, chunk_size)]
                        first = at // chunk_size
                        yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(cut)), pa.array(range(first, first + len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["key", "chunk", "bytes"])
                        at += step

    return read


def _uri(path: str) -> str:
    """Hadoop's name of a file as a URI: local ones get three slashes, and what a URI can't hold is escaped."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}://{quote('/' + rest.lstrip('/') if scheme == 'file' else rest.lstrip('/'))}"
