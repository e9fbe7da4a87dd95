"""Joins of facts and children with versioned records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import as_of, is_open


def get_many(ids: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """One row an id, with NULLs where there is no live record."""
    return ids.select(key).distinct().join(current, key, "left")


def join_current(child: DataFrame, parent: DataFrame, child_key: str, key: str = "id", how: str = "inner") -> DataFrame:
    """Children with the live version of their parent; the parent's columns are prefixed with parent_."""
    live = parent.where(is_open(parent) & F.col("deleted_at").isNull()).drop("is_open")
    return child.join(_prefixed(live, child_key, key), child_key, how)


def join_at(child: DataFrame, parent: DataFrame, instant: Any, child_key: str, child_created: str, key: str = "id") -> DataFrame:
    """Children that existed at the instant, with the parent version valid then."""
    return child.where(F.col(child_created) <= F.lit(instant)).join(_prefixed(as_of(parent, instant), child_key, key), child_key)


def _prefixed(parent: DataFrame, child_key: str, key: str) -> DataFrame:
    return parent.select(F.col(key).alias(child_key), *(F.col(c).alias(f"parent_{c}") for c in parent.columns if c != key))


def join_asof(child: DataFrame, parent: DataFrame, child_key: str, child_time: str, columns: list[str], key: str = "id", skewed: bool = False) -> DataFrame:
    """Each child row with the parent version valid at its own time, or NULLs.

    The id is an equality in either way. By default it is an equi-join with a range condition; `skewed`
    unions both sides and carries the last version forward in a window: linear in rows where
    one id has many versions and many children. Both need validity periods that don't overlap.
    """
    if not skewed:
        p = parent.select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.col("deleted_at").alias("_gone"), *(F.col(c).alias(f"parent_{c}") for c in columns))
        t = F.col(child_time)
        valid = (F.col(child_key) == F.col("_k")) & (F.col("_from") <= t) & (F.col("_to").isNull() | (F.col("_to") > t)) & (F.col("_gone").isNull() | (F.col("_gone") > t))
        return child.join(p, valid, "left").drop("_k", "_from", "_to", "_gone")
    kind = dict(child.dtypes)[child_time]
    versions = parent.select(
        F.col(key).alias("_k"), F.col("valid_from").cast(kind).alias("_t"), F.lit(0).alias("_child"), F.col("version").alias("_v"),
        F.struct(F.col("valid_to").cast(kind).alias("_to"), F.col("deleted_at").cast(kind).alias("_gone"), *columns).alias("_p"), F.lit(None).cast(child.schema).alias("_c"),
    )
    children = child.select(F.col(child_key).alias("_k"), F.col(child_time).alias("_t"), F.lit(1).alias("_child"), F.lit(None).cast("int").alias("_v"), F.lit(None).cast(versions.schema["_p"].dataType).alias("_p"), F.struct(*child.columns).alias("_c"))
    w = Window.partitionBy("_k").orderBy("_t", "_child", "_v")
    last = F.last("_p", ignorenulls=True).over(w)
    found = versions.unionByName(children).withColumn("_p", last).where("_child = 1")
    valid = (F.col("_p._to").isNull() | (F.col("_p._to") > F.col("_t"))) & (F.col("_p._gone").isNull() | (F.col("_p._gone") > F.col("_t")))
    return found.select("_c.*", *(F.when(valid, F.col("_p")[c]).alias(f"parent_{c}") for c in columns))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, key: str = "id") -> DataFrame:
    """Children whose parent id does not exist; a null reference is none."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti").select(*child.columns)


def parent_not_current(child: DataFrame, parent: DataFrame, child_key: str, key: str = "id") -> DataFrame:
    """Children whose parent exists but has no live version: one pass over the parents' keys."""
    state = parent.groupBy(F.col(key).alias(child_key)).agg(F.max(F.col("valid_to").isNull() & F.col("deleted_at").isNull()).alias("_live"))
    return child.join(state.where("not _live"), child_key, "left_semi").select(*child.columns)


def current_view(table: DataFrame) -> DataFrame:
    return table.where("valid_to is null and deleted_at is null")


def fk_delete_rule(child: DataFrame, deleted: DataFrame, child_key: str, rule: str, key: str = "id") -> DataFrame:
    """The effect of deleting parents: RESTRICT gives the children in the way, CASCADE the children left, SET NULL all with the reference cleared."""
    gone = deleted.select(F.col(key).alias(child_key)).distinct()
    if rule == "RESTRICT":
        return child.join(gone, child_key, "left_semi").select(*child.columns)
    if rule == "CASCADE":
        return child.join(gone, child_key, "left_anti").select(*child.columns)
    if rule == "SET NULL":
        return child.join(gone.withColumn("_gone", F.lit(True)), child_key, "left").withColumn(child_key, F.when(F.col("_gone").isNull(), F.col(child_key))).select(*child.columns)
    raise ValueError(f"unknown rule {rule!r}")


def hierarchy(df: DataFrame, parent_ref: str, columns: list[str], key: str = "id") -> DataFrame:
    """Each row with its parent row's columns (one level)."""
    parents = df.select(F.col(key).alias(parent_ref), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return df.join(parents, parent_ref, "left")


def ids_from(values: list, df: DataFrame, key: str = "id") -> DataFrame:
    """A listed set of ids as a DataFrame of the table's key type."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{key} {dict(df.dtypes)[key]}")


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
