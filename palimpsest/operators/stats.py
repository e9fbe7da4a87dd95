"""Counts and statistics of records, query logs and pool samples."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import TableSpec
from .filters import live, quoted

SLOW_SECONDS = 1.0
_QUANTILES = (0.5, 0.95, 0.99)
#: Share of a group on each side of a quantile that the exact way looks at; sketches are four times as fine.
_SLACK = 0.002


def count_rows(df: DataFrame, spec: TableSpec, by: tuple[str, ...] = (), include_deleted: bool = False, all_versions: bool = False) -> DataFrame:
    """Live records by group; include_deleted counts logical records, all_versions every row."""
    rows = df if all_versions else df.where(live(spec, include_deleted))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def query_stats(log: DataFrame, now: Any, window_minutes: int = 60, slow: float = SLOW_SECONDS, by: tuple[str, ...] = ()) -> DataFrame:
    """Over the last minutes of a log (timestamp, duration, success): totals, success rate, durations, slow ones."""
    t = F.lit(now)
    recent = log.where((F.col("timestamp") > t - F.make_dt_interval(mins=F.lit(window_minutes))) & (F.col("timestamp") <= t))
    ok = F.sum(F.col("success").cast("long"))
    return recent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(ok, F.lit(0)).alias("succeeded"), (F.count(F.lit(1)) - F.coalesce(ok, F.lit(0))).alias("failed"),
        F.coalesce(ok * 100.0 / F.count(F.lit(1)), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.min("duration"), F.lit(0.0)).alias("min_duration"), F.coalesce(F.max("duration"), F.lit(0.0)).alias("max_duration"),
        F.count(F.when(F.col("duration") > slow, 1)).alias("slow"),
    )


def timing_stats(log: DataFrame, key: str, value: str = "duration", approximate: bool = False) -> DataFrame:
    """Count, mean, extremes and percentiles (linearly interpolated) by key; NULL values don't count.

    Exact percentiles take two passes: sketches give bounds that surely hold each wanted rank, and
    only the distinct values between them are counted and ranked, so no task sees a whole group.
    approximate=True stops at the sketches.
    """
    plain = log.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile_approx(value, [x for q in _QUANTILES for x in (max(q - _SLACK, 0.0), q, min(q + _SLACK, 1.0))], F.lit(int(4 / _SLACK))).alias("p"),
    )
    if approximate:
        return plain.select(key, "n", "mean", "min", "max", *(F.col("p")[3 * k + 1].alias(name) for k, name in enumerate(("p50", "p95", "p99"))))
    # In a small group a few ranks are more than the slack: all its values lie between the bounds.
    bound = lambda at, end: F.when(F.col("n") * _SLACK < 4, F.col(end)).otherwise(F.col("p")[at])
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("n") - 1)).alias("rank"), bound(3 * k, "min").alias("low"), bound(3 * k + 2, "max").alias("high")) for k, q in enumerate(_QUANTILES)))
    ranges = plain.where("n > 0").select(F.col(key).alias("_key"), F.explode(wanted).alias("w")).select("_key", "w.*")
    near = log.where(F.col(value).isNotNull()).join(ranges, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(value) <= F.col("high"))
    # Everything under the lower bound is one count; above it, one for each distinct value.
    counted = near.groupBy("_key", "k", "rank", F.when(F.col(value) >= F.col("low"), F.col(value)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_key", "k").orderBy(F.asc_nulls_first("v")))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    floor = at(F.floor("rank"))
    value_at = floor + (F.first("rank") - F.floor(F.first("rank"))) * (at(F.ceil("rank")) - floor)
    exact = counted.withColumn("upto", upto).groupBy("_key", "k").agg(value_at.alias("x")).groupBy("_key").pivot("k", list(range(len(_QUANTILES)))).agg(F.first("x"))
    exact = exact.toDF("_key", "p50", "p95", "p99")
    return plain.join(exact, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", "mean", "min", "max", "p50", "p95", "p99")


def operation_counts(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.when(F.col("success"), 1)).alias("success"), F.count(F.when(~F.col("success"), 1)).alias("failed"))


def slow_queries(log: DataFrame, slow: float = SLOW_SECONDS, limit: int = 100, tie: tuple[str, ...] = ()) -> DataFrame:
    """The latest queries over the threshold."""
    return log.where(F.col("duration") > slow).orderBy(F.desc("timestamp"), *tie).limit(limit)


def pool_stats(samples: DataFrame, key: str = "pool", last: int = 100) -> DataFrame:
    """Of each pool: the latest sample, and mean utilisation and exhaustions over its last samples."""
    use = F.when(F.col("pool_size") > 0, F.col("active_connections") * 100.0 / F.col("pool_size")).otherwise(0.0)
    out = (F.col("active_connections") >= F.col("pool_size")) & (F.col("waiting_requests") > 0)
    w = Window.partitionBy(key).orderBy(F.desc("timestamp"))
    recent = samples.withColumns({"utilisation": use, "exhausted": out}).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    return recent.groupBy(key).agg(
        F.max("timestamp").alias("latest_at"), F.max_by("utilisation", "timestamp").alias("latest_utilisation"), F.max_by("active_connections", "timestamp").alias("latest_active"),
        F.avg("utilisation").alias("avg_utilisation"), F.sum(F.col("exhausted").cast("long")).alias("exhaustions"), F.count(F.lit(1)).alias("samples"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
