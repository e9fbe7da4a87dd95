"""Current-state tables: applying a feed, upsert, bulk update and delete, restore."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import NONE, TableSpec, register_strategy
from .changes import id_window, judged, rejected, united, with_states
from .filters import condition, quoted


def change_log(base: DataFrame | None, feed: DataFrame, spec: TableSpec) -> DataFrame:
    """The feed's rows and the touched base rows: `ok`, `reason`, and of accepted ones states and managed columns as they stand after each, and `last`.

    One exchange by id makes table, audit entries and rejects; who needs several of them may keep the log and read it for each.
    Rejected rows are a partition of their own in every window, so a filter on `ok` goes below the windows.
    """

    def managed(rows: DataFrame) -> DataFrame:
        chain = with_states(rows.withColumn("ok", F.col("reason").isNull()), spec, "ok")
        w = id_window(spec, "ok")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        is_base = F.col("op") == "base"

        def last(of_base: str, when: Column, value: str) -> Column:
            return F.last(F.when(is_base, F.struct(F.col(of_base).alias("v"))).when(when, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(upto)["v"]

        by_user = F.col("op").isin("update", "transfer", "restore") & F.col("user_id").isNotNull()
        gone = F.col("op").isin("delete", "restore", "create")
        return chain.withColumns(
            {
                "created_at": F.first(F.when(is_base, F.col("was_created_at")).otherwise(F.col("change_ts"))).over(upto),
                "created_by": F.first(F.when(is_base, F.struct(F.col("was_created_by").alias("v"))).otherwise(F.struct(F.col("user_id").alias("v")))).over(upto)["v"],
                "updated_at": last("was_updated_at", F.col("op").isin("create", "update", "transfer", "restore"), "change_ts"),
                "updated_by": last("was_updated_by", by_user, "user_id"),
                "deleted_at": F.last(F.when(is_base, F.struct(F.col("was_deleted_at").alias("v"))).when(gone, F.struct(F.when(F.col("op") == "delete", F.col("change_ts")).alias("v"))), ignorenulls=True).over(upto)["v"],
                "deleted_by": F.last(F.when(is_base, F.struct(F.col("was_deleted_by").alias("v"))).when(gone, F.struct(F.when(F.col("op") == "delete", F.col("user_id")).alias("v"))), ignorenulls=True).over(upto)["v"],
                "last": F.lead("op").over(w).isNull(),
            }
        )

    return united(judged(base, feed, spec), managed)


def state_of(log: DataFrame, base: DataFrame | None, feed: DataFrame, spec: TableSpec) -> DataFrame:
    """The last state of each record of the log, and the base's untouched records."""
    last = log.where(F.col("ok") & F.col("last"))
    if not spec.soft_delete:  # a hard delete removes the record
        last = last.where("deleted_at is null")
    built = last.select(
        spec.key, *(quoted(f"new_{f}").alias(f) for f in spec.user_fields), "created_at", "updated_at", "created_by", "updated_by",
        *((F.col("own_tenant").alias(spec.tenant_field),) if spec.multi_tenant else ()), *(("deleted_at", "deleted_by") if spec.soft_delete else ()),
    )
    if base is None:
        return built
    return built.unionByName(base.join(feed.select(spec.key).distinct(), spec.key, "left_anti").select(*built.columns))


def apply_none(base: DataFrame | None, feed: DataFrame, spec: TableSpec, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Apply a feed to a current-state table: {"table": ..., "rejects": ...}; keep writes the change log, where both are read."""
    log = change_log(base, feed, spec)
    log = keep(log) if keep else log
    return {"table": state_of(log, base, feed, spec), "rejects": rejected(log, feed, spec)}


register_strategy(NONE, apply_none)


def restore(table: DataFrame, ids: DataFrame, instant: Any, spec: TableSpec) -> DataFrame:
    """Un-delete records; only the strategy `none` has this."""
    if spec.strategy != NONE:
        raise ValueError("restore exists only for the strategy none")
    marked = table.join(ids.select(spec.key, F.lit(True).alias("wanted")).distinct(), spec.key, "left")
    back = F.coalesce(F.col("wanted"), F.lit(False)) & F.col("deleted_at").isNotNull()
    return marked.withColumns(
        {"updated_at": F.when(back, F.lit(instant)).otherwise(F.col("updated_at")), "deleted_at": F.when(~back, F.col("deleted_at")), "deleted_by": F.when(~back, F.col("deleted_by"))}
    ).select(*table.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, newest: Sequence[Column] = ()) -> DataFrame:
    """Match on keys: matched rows take the columns of `update` (default: all others), unmatched ones are inserted.

    The source's duplicates are settled first: the first by `newest`, else the least row, stays.
    """
    w = Window.partitionBy(*keys).orderBy(*(newest or [F.struct(*source.columns)]))
    once = source.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    chosen = set(update if update is not None else [c for c in source.columns if c not in keys])
    t, s = target.select(*keys, F.struct(*target.columns).alias("t")), once.select(*keys, F.struct(*source.columns).alias("s"))
    joined = t.join(s, list(keys), "full")
    columns = []
    for c in target.columns:
        new = F.col("s")[c] if c in source.columns else F.lit(None)
        columns.append((F.coalesce(*(F.col(x)[c] for x in ("t", "s"))) if c in keys else F.when(F.col("t").isNull(), new).when(F.col("s").isNotNull() & F.lit(c in chosen), new).otherwise(F.col("t")[c])).alias(c))
    return joined.select(*columns)


def update_where(df: DataFrame, data: Mapping[str, Any], where: Mapping[str, Any]) -> DataFrame:
    if not data or not where:
        raise ValueError("update_where needs data and a condition")
    hit = F.coalesce(condition(where), F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(quoted(c)) for c, v in data.items()})


def delete_where(df: DataFrame, where: Mapping[str, Any]) -> DataFrame:
    if not where:
        raise ValueError("delete_where needs a condition")
    return df.where(~F.coalesce(condition(where), F.lit(False)))
