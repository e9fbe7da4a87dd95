"""Ordered pages and ranks."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import quoted


def list_page(df: DataFrame, limit: int = 100, offset: int = 0, key: str = "id") -> DataFrame:
    """Newest first, ties by id. Deep pages are cheaper with page_after."""
    out = df.orderBy(F.desc("created_at"), key)
    return (out.offset(offset) if offset else out).limit(limit)


def page_after(df: DataFrame, created_at: Any, record_id: Any, limit: int = 100, key: str = "id") -> DataFrame:
    """The page that follows a row: a filter and a top-k instead of an offset."""
    after = (F.col("created_at") < F.lit(created_at)) | ((F.col("created_at") == F.lit(created_at)) & (F.col(key) > F.lit(record_id)))
    return df.where(after).orderBy(F.desc("created_at"), key).limit(limit)


def validated_order(df: DataFrame, column: str, allowed: list[str], direction: str = "ASC") -> DataFrame:
    if column not in allowed:
        raise ValueError(f"column not allowed: {column}")
    if direction.upper() not in ("ASC", "DESC"):
        raise ValueError(f"direction must be ASC or DESC, not {direction!r}")
    return df.orderBy(quoted(column).asc() if direction.upper() == "ASC" else quoted(column).desc())


def rank_versions(table: DataFrame, key: str = "id") -> DataFrame:
    """rn = 1 is an id's newest version."""
    return table.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version"))))


def latest_per_key(table: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each id, whatever valid_to says; a hash aggregate with map-side combining, no sort."""
    return table.groupBy(key).agg(F.max_by(F.struct(*(c for c in table.columns if c != key)), "version").alias("r")).select(key, "r.*").select(*table.columns)
