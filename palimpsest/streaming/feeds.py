"""Unbounded feeds: versions, audited tables and windowed query statistics as they arrive.

A streamed table is a log: what a batch adds is written once, into folders of the batch's own. Closed versions, audit rows and
rejects are only ever appended. The records' current rows, which the next batch needs, are a log of deltas, one for each batch
with the rows that it touched; deltas are merged two by two, as binary counting does, so a row is written again once for
each doubling of the number of batches, and never more than one delta a binary digit is read. Bytes written
follow the batches, not the table. A commit is written last and names how far the log goes: what a
crash leaves behind it is not read, and a batch that is run again writes the same folders.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit import apply_audited
from ..operators.current import apply_none
from ..operators.scd2 import apply_scd2
from ..spec import AUDITED, SCD2, TableSpec

#: Parts of the current rows; a batch reads those that its records are in.
BUCKETS = 64
#: Batches whose (id, seq) are remembered, for rows that a source delivers again.
HORIZON = 100
#: Batch numbers of flushes, beyond those of any stream.
_FLUSHED = 10**11


@dataclass(frozen=True)
class Commit:
    """That a batch is written: its place in the log, and the newest instant so far."""

    batch: int
    place: int
    newest: str | None


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _commits(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(place, batch) of the commits, in order."""
    names = [n for n in _children(spark, f"{path}/commits") if n.count("-") == 1 and not n.startswith(".")]
    return sorted((int(n.split("-")[0]), int(n.split("-")[1])) for n in names)


def _commit_at(spark: SparkSession, path: str, place: int, batch: int) -> Commit:
    fs, at = _fs(spark, f"{path}/commits/{place:012d}-{batch:012d}")
    stream = fs.open(at)
    try:
        return Commit(batch, place, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["newest"])
    finally:
        stream.close()


def _write_commit(spark: SparkSession, path: str, commit: Commit) -> None:
    fs, draft = _fs(spark, f"{path}/commits/.{commit.place}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"newest": commit.newest}).encode()))
    out.close()
    final = _fs(spark, f"{path}/commits/{commit.place:012d}-{commit.batch:012d}")[1]
    if not fs.exists(final) and not fs.rename(draft, final):
        raise OSError(f"{final} could not be written")


def runs_at(place: int) -> list[int]:
    """The deltas that make up the current rows after so many batches, the newest first: the delta of batch n holds as many batches as n's lowest binary digit says."""
    out = []
    while place:
        out.append(place)
        place -= place & -place
    return out


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """Of each record the row of its latest batch; a hash aggregate."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "_place").alias("r")).select(key, "r.*")


def _state(spark: SparkSession, path: str, runs: list[int], key: str, buckets: list[int] | None = None, ids: DataFrame | None = None) -> DataFrame | None:
    """The newest rows among deltas, of some records only where ids are given; None without any rows."""
    parts = []
    for run in runs:
        if not any(n.startswith("bucket=") for n in _children(spark, f"{path}/state/run={run}")):
            continue  # no row: no bucket
        rows = spark.read.option("basePath", f"{path}/state/run={run}").parquet(f"{path}/state/run={run}")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        parts.append(rows.drop("bucket") if ids is None else rows.drop("bucket").join(ids, key, "left_semi"))
    return _newest(reduce(DataFrame.unionByName, parts), key) if parts else None


def _appended(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The committed rows of an appended part; None before the first."""
    commits = _commits(spark, path)
    if not commits:
        return None
    return spark.read.parquet(f"{path}/{name}").where(F.col("place") <= commits[-1][0]).drop("place")


def read_current(spark: SparkSession, path: str, key: str = "id") -> DataFrame | None:
    """The records' current rows (open versions, tombstones among them) as of the last committed batch; None before the first of them."""
    commits = _commits(spark, path)
    rows = _state(spark, path, runs_at(commits[-1][0]), key) if commits else None
    return None if rows is None else rows.where("not _gone").drop("_gone", "_place")


def read_versions(spark: SparkSession, path: str, key: str = "id") -> DataFrame | None:
    """All versions that a stream has written, as of its last committed batch; None before the first."""
    current = read_current(spark, path, key)
    return None if current is None else current.unionByName(_appended(spark, path, "versions"))


def read_audit(spark: SparkSession, path: str) -> DataFrame | None:
    return _appended(spark, path, "audit")


def read_rejects(spark: SparkSession, path: str) -> DataFrame | None:
    """What was rejected, and why, of committed batches."""
    return _appended(spark, path, "rejects")


def table_batch(path: str, spec: TableSpec, delay: dt.timedelta | None = None, horizon: int = HORIZON, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: apply a batch to the streamed table at path.

    Within a batch rows are applied by (change_ts, seq). With a delay, rows newer than the newest instant less
    the delay wait for the next batch, so that rows which come late by less are applied in order; `flush` applies what
    waits. Rows older than their record's current one are rejects (`late`). Of rows with the same (id, seq) in a batch the
    first stays; those that one of the last `horizon` batches has had are passed over. A replay from
    further back can't change the table: its rows are late, or repeat what is there, and are rejects or no changes.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = _commits(spark, path)
        known = [place for place, n in commits if n == number]
        if known and known[0] != commits[-1][0]:
            return  # long written
        place = known[0] if known else (commits[-1][0] + 1 if commits else 1)
        before = _commit_at(spark, path, *commits[-2 if known else -1]) if len(commits) > len(known) else None
        _apply(spark, batch, number, place, before, delay)

    def _apply(spark: SparkSession, batch: DataFrame, number: int, place: int, before: Commit | None, wait: dt.timedelta | None) -> None:
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return df

        def write(df: DataFrame, name: str, *by: str) -> None:
            df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")

        bucket = F.pmod(F.xxhash64(F.col(spec.key)), F.lit(buckets)).cast("int")
        try:
            if place > 1 and f"place={place - 1}" in _children(spark, f"{path}/pending"):
                batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/pending/place={place - 1}"))
            batch = keep(batch)
            newest = batch.agg(F.date_format(F.max("change_ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
            newest = max(filter(None, (newest, before.newest if before else None)), default=None)
            ready = batch
            if wait is not None and newest is not None:
                waits = F.coalesce(F.col("change_ts") > F.lit(dt.datetime.fromisoformat(newest) - wait), F.lit(False))
                write(batch.where(waits), f"pending/place={place}")
                ready = batch.where(~waits)
            once = Window.partitionBy(spec.key, "seq").orderBy("change_ts", F.xxhash64(*ready.columns))
            fresh = ready.withColumn("_n", F.row_number().over(once)).where("_n = 1 or seq is null").drop("_n")
            if before is not None:
                seen = spark.read.parquet(f"{path}/seen").where(F.col("place").between(place - horizon, place - 1))
                fresh = fresh.join(seen.select(spec.key, "seq").distinct(), [spec.key, "seq"], "left_anti").select(*batch.columns)
            fresh = keep(fresh)
            ids = fresh.select(spec.key).where(F.col(spec.key).isNotNull()).distinct()
            touched = sorted(r[0] for r in ids.select(bucket).distinct().collect())  # BUCKETS numbers at most
            base = _state(spark, path, runs_at(place - 1), spec.key, touched, ids)
            base = None if base is None else keep(base.where("not _gone").drop("_gone", "_place"))

            if spec.strategy == SCD2:
                out = apply_scd2(base, fresh, spec)
                built = keep(out["open"])
                write(built.where("valid_to is not null"), f"versions/place={place}")
                rows = built.where("valid_to is null").withColumn("_gone", F.lit(False))
            else:
                out = (apply_audited if spec.strategy == AUDITED else apply_none)(base, fresh, spec, keep)
                rows = out["table"].withColumn("_gone", F.lit(False))
                if base is not None and not spec.soft_delete:
                    rows = rows.unionByName(base.join(rows.select(spec.key), spec.key, "left_anti").select(*base.columns).withColumn("_gone", F.lit(True)))
                if spec.strategy == AUDITED:
                    write(out["audit"], f"audit/place={place}")
            write(out["rejects"], f"rejects/place={place}")
            write(fresh.where("seq is not null").select(spec.key, "seq"), f"seen/place={place}")
            rows = rows.withColumn("_place", F.lit(place).cast("long"))
            first = place - (place & -place)  # the delta takes in those after it
            merged = _state(spark, path, [r for r in runs_at(place - 1) if r > first], spec.key)
            if merged is not None:
                rows = _newest(rows.unionByName(merged), spec.key)
            if not first:
                rows = rows.where("not _gone")
            write(rows.withColumn("bucket", bucket).repartition("bucket"), f"state/run={place}", "bucket")
            _write_commit(spark, path, Commit(number, place, newest))
            _clean(spark, place)
        finally:
            for df in reversed(kept):
                df.unpersist()

    def _clean(spark: SparkSession, place: int) -> None:
        """Delete what neither the next batch nor this one, run again, reads."""
        needed = {f"run={r}" for r in (*runs_at(place), *runs_at(place - 1))}
        stale = [f"state/{n}" for n in _children(spark, f"{path}/state") if n not in needed]
        stale += [f"seen/{n}" for n in _children(spark, f"{path}/seen") if int(n.removeprefix("place=")) < place - horizon]
        stale += [f"pending/{n}" for n in _children(spark, f"{path}/pending") if int(n.removeprefix("place=")) < place - 1]
        for name in stale:
            fs, at = _fs(spark, f"{path}/{name}")
            fs.delete(at, True)

    def finish(spark: SparkSession) -> None:
        commits = _commits(spark, path)
        if not commits or f"place={commits[-1][0]}" not in _children(spark, f"{path}/pending"):
            return
        place, number = commits[-1]
        waiting = spark.read.parquet(f"{path}/pending/place={place}")
        _apply(spark, waiting.limit(0), _FLUSHED + place, place + 1, _commit_at(spark, path, place, number), None)

    apply.flush = finish
    return apply


def flush(spark: SparkSession, path: str, spec: TableSpec, **options: Any) -> None:
    """Apply the rows that still wait for older ones, once a stream with a delay has ended."""
    table_batch(path, spec, **options).flush(spark)


def stream_table(feed: DataFrame, path: str, checkpoint: str, spec: TableSpec, delay: dt.timedelta | None = None, horizon: int = HORIZON, buckets: int = BUCKETS, **trigger: Any):
    """Apply a feed stream to the table at path, of any strategy."""
    return feed.writeStream.foreachBatch(table_batch(path, spec, delay, horizon, buckets)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def stream_scd2(feed: DataFrame, path: str, checkpoint: str, spec: TableSpec, **options: Any):
    """The versions of a feed stream; see read_versions."""
    return stream_table(feed, path, checkpoint, spec, **options)


def stream_audit(feed: DataFrame, path: str, checkpoint: str, spec: TableSpec, **options: Any):
    """The audited table of a feed stream; see read_audit and read_current."""
    return stream_table(feed, path, checkpoint, spec, **options)


def stream_query_stats(log: DataFrame, window: str = "60 minutes", slide: str | None = None, late: str = "10 minutes", slow: float = 1.0) -> DataFrame:
    """Windowed statistics of a log stream (timestamp, operation, duration, success); rows beyond the watermark are dropped: stream_late_rows has them."""
    span = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out = log.withWatermark("timestamp", late).groupBy(span, "operation").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("success"), 1)).alias("succeeded"), F.avg("duration").alias("avg_duration"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.count(F.when(F.col("duration") > slow, 1)).alias("slow"),
    )
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "operation", "total", "succeeded", "avg_duration", "min_duration", "max_duration", "slow")


def late_batch(path: str, window: str, slide: str | None, late: dt.timedelta) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the rows whose last window had closed before their batch: it ends at the newest instant of the batches before, less `late`, or earlier."""

    def last_end() -> Column:
        return F.window("timestamp", slide or window)["start"] + F.expr(f"INTERVAL {window}")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = [c for c in _commits(spark, path) if c[1] < number]
        newest = _commit_at(spark, path, *commits[-1]).newest if commits else None
        own = batch.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        gone = F.lit(False) if newest is None else last_end() <= F.to_timestamp(F.lit(str(dt.datetime.fromisoformat(newest) - late)))
        batch.where(gone).write.mode("overwrite").parquet(f"{path}/late/place={number + 1}")
        _write_commit(spark, path, Commit(number, number + 1, max(filter(None, (newest, own)), default=None)))

    return apply


def stream_late_rows(log: DataFrame, path: str, checkpoint: str, window: str = "60 minutes", slide: str | None = None, late: dt.timedelta = dt.timedelta(minutes=10), **trigger: Any):
    """What stream_query_stats over the same log, in the same batches, drops; see read_late_rows."""
    return log.writeStream.foreachBatch(late_batch(path, window, slide, late)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_late_rows(spark: SparkSession, path: str) -> DataFrame | None:
    return _appended(spark, path, "late")
