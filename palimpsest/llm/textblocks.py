"""Shared helpers of this subpackage: documents as Arrow byte blocks.

Python tasks here work on a block of documents at a time: the Arrow string
column already holds all texts back to back, so numpy sees one byte array and
the row offsets, and no per-document Python loop is needed in the hot parts.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: What the documents table has; operators look at these by name and ignore others.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, a null text as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers has the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; where it is unset, only a local master has one, below its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_scope: ContextVar[list[DataFrame] | None] = ContextVar("kept_on_disk", default=None)


def kept_on_disk(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks with its lineage: what a lost executor held is computed again. The scope it is made in gives it up."""
    df = df.persist(StorageLevel.DISK_ONLY)
    held = _scope.get()
    if held is not None:
        held.append(df)
    return df


def _give_up(held: list[DataFrame]) -> None:
    # Last ones first: giving up what others are made from plans these anew.
    while held:
        df = held.pop()
        if SparkContext._active_spark_context is not None:
            df.unpersist()


def give_up(df: DataFrame) -> None:
    """End what kept_on_disk keeps before its scope does; nothing of it, nor of what it is made from, is held any more."""
    df.unpersist()
    held = _scope.get()
    if held is not None:
        held[:] = [x for x in held if x is not df]


@contextmanager
def released() -> Iterator[None]:
    """On leaving, what kept_on_disk kept within is given up, in this thread; tables that the caller cached stay."""
    held: list[DataFrame] = []
    token = _scope.set(held)
    try:
        yield
    finally:
        _scope.reset(token)
        _give_up(held)


def until_result_ends(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What the operator keeps is given up with the DataFrame object that it returns; within released(), with that.

    A result that is only a step of another one is kept with it by `with_sources`; where it isn't, what it kept is
    computed again, not lost.
    """

    @wraps(operator)
    def call(*args: Any, **named: Any) -> DataFrame:
        if _scope.get() is not None:
            return operator(*args, **named)
        held: list[DataFrame] = []
        token = _scope.set(held)
        try:
            result = operator(*args, **named)
        except BaseException:
            _give_up(held)
            raise
        finally:
            _scope.reset(token)
        if held:
            weakref.finalize(result, _give_up, held).atexit = False
        return result

    return call


def with_sources(result: DataFrame, *sources: DataFrame) -> DataFrame:
    """The result, holding the DataFrame objects it is made from."""
    result._sources = sources
    return result
