"""Versioned tables: applying a feed, history, and differences of versions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonval import audit_json
from ..spec import SCD2, TableSpec, register_strategy
from .changes import id_window, judged, rejected, united, with_states
from .filters import is_open, quoted


def _versions(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """The versions that judged rows make, those of op `base` included."""
    accepted = with_states(rows.where("reason is null"), spec)
    kept = accepted.where(F.col("changed") | F.col("op").isin("base", "create", "delete", "transfer"))
    w = id_window(spec)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.first("was_version", ignorenulls=True).over(upto)
    kept = kept.withColumn("version", (F.coalesce(start, F.lit(0)) + F.sum(F.when(F.col("op") == "base", 0).otherwise(1)).over(upto)).cast("int"))
    is_base, dead = F.col("op") == "base", F.col("op") == "delete"
    kept = kept.withColumn("from", F.when(is_base, F.col("was_valid_from")).otherwise(F.col("change_ts")))
    first = lambda old, new: F.first(F.when(is_base, F.struct(F.col(old).alias("v"))).otherwise(F.struct(F.col(new).alias("v")))).over(upto)["v"]
    return kept.select(
        spec.key,
        *(quoted(f"new_{f}").alias(f) for f in spec.user_fields),
        first("was_created_at", "change_ts").alias("created_at"),
        F.when(is_base, F.col("was_updated_at")).otherwise(F.col("change_ts")).alias("updated_at"),
        first("was_created_by", "user_id").alias("created_by"),
        F.last(F.when(is_base, F.col("was_updated_by")).when(F.col("op").isin("update", "transfer"), F.col("user_id")), ignorenulls=True).over(upto).alias("updated_by"),
        *((F.col("own_tenant").alias(spec.tenant_field),) if spec.multi_tenant else ()),
        F.when(is_base, F.col("was_deleted_at")).when(dead, F.col("change_ts")).alias("deleted_at"),
        F.when(is_base, F.col("was_deleted_by")).when(dead, F.col("user_id")).alias("deleted_by"),
        F.col("from").alias("valid_from"),
        F.lead("from").over(w).alias("valid_to"),
        "version",
    )


def apply_scd2(base: DataFrame | None, feed: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """Apply a feed: {"table": all versions, "open": only the touched records' rows, "rejects": ...}.

    A create makes version 1; an update that changes a user field closes the current version and
    adds the next; one that changes nothing adds none; a transfer adds one under the new tenant, whose rows are
    accepted from then on; a delete adds a tombstone, after which nothing is accepted. Closed versions of the base are
    passed through and never sorted.
    """
    current = None if base is None else base.where(is_open(base))
    rows = judged(current, feed, spec)
    built = united(rows, lambda r: _versions(r, spec))
    table = built
    if base is not None:
        closed = base.where(~is_open(base))
        untouched = current.join(feed.select(spec.key).distinct(), spec.key, "left_anti")
        table = built.unionByName(closed.select(*built.columns)).unionByName(untouched.select(*built.columns))
    return {"table": table, "open": built, "rejects": rejected(united(rows, lambda r: r), feed, spec)}


register_strategy(SCD2, apply_scd2)


def transfer_feed(table: DataFrame, requests: DataFrame, spec: TableSpec) -> DataFrame:
    """requests (id, new_tenant_id, change_ts, user_id and, where given, seq and the tenant that must own the record) as feed rows."""
    have = set(requests.columns)
    kinds = {f.name: f.dataType for f in table.schema}
    none = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    return requests.select(
        spec.key, F.lit("transfer").alias("op"), "change_ts", none("seq", "long"), none(spec.tenant_field, kinds[spec.tenant_field]), "user_id",
        *(F.lit(None).cast(kinds[f]).alias(f) for f in spec.user_fields), F.array().cast("array<string>").alias("set_fields"), F.col("new_tenant_id").cast(kinds[spec.tenant_field]).alias("new_tenant_id"),
    )


def transfer_ownership(table: DataFrame, requests: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """Give records to other tenants: a new version each; several requests for a record follow each other by (change_ts, seq).

    Rejected where the record is not found or deleted, the new tenant is null or has it already, or the request is older than
    the record's current version.
    """
    out = apply_scd2(table, transfer_feed(table, requests, spec), spec)
    return {"table": out["table"].select(*table.columns), "rejects": out["rejects"].select(spec.key, "new_tenant_id", "reason")}


def version_history(table: DataFrame, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    out = table if ids is None else table.join(ids.select(key).distinct(), key, "left_semi").select(*table.columns)
    return out.orderBy(key, "version")


def version_info(table: DataFrame, key: str = "id") -> DataFrame:
    return table.select(key, "version", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), F.col("deleted_at").isNotNull().alias("is_deleted"))


def compare_versions(table: DataFrame, version_1: int, version_2: int, fields: list[str], key: str = "id") -> DataFrame:
    """(id, field_name, old_value, new_value, changed) of each id that has both versions; values as JSON text."""
    a, b = (table.where(F.col("version") == v).select(key, F.struct(*map(quoted, fields)).alias(n)) for v, n in ((version_1, "a"), (version_2, "b")))
    kinds = dict(table.dtypes)
    entries = F.array(*(F.struct(F.lit(f).alias("field_name"), audit_json(F.col("a")[f], kinds[f]).alias("old_value"), audit_json(F.col("b")[f], kinds[f]).alias("new_value"), (~F.col("a")[f].eqNullSafe(F.col("b")[f])).alias("changed")) for f in fields))
    return a.join(b, key).select(key, F.explode(entries).alias("e")).select(key, "e.*")


def version_deltas(table: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Changed fields between each version and the one before it, for all ids in one sort."""
    w = Window.partitionBy(key).orderBy("version")
    kinds = dict(table.dtypes)
    paired = table.select(key, "version", F.struct(*map(quoted, fields)).alias("b"), F.lag(F.struct(*map(quoted, fields))).over(w).alias("a")).where("a is not null")
    entries = F.array(*(F.when(~F.col("a")[f].eqNullSafe(F.col("b")[f]), F.struct(F.lit(f).alias("field_name"), audit_json(F.col("a")[f], kinds[f]).alias("old_value"), audit_json(F.col("b")[f], kinds[f]).alias("new_value"))) for f in fields))
    return paired.select(key, "version", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(key, "version", "e.*")


def version_count(table: DataFrame, key: str = "id") -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n_versions"))


def version_timeline(table: DataFrame, key: str = "id") -> DataFrame:
    """Validity periods with their lengths in seconds; open ones have none."""
    return table.select(key, "version", "valid_from", "valid_to", (F.unix_micros(F.col("valid_to").cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))).alias("valid_micros"))


def changes_between(table: DataFrame, start: Any, end: Any) -> DataFrame:
    return table.where(F.col("valid_from").between(F.lit(start), F.lit(end)))


def first_time_value(table: DataFrame, field: str, value: Any, key: str = "id") -> DataFrame:
    """When each id's field first had the value."""
    return table.where(quoted(field).eqNullSafe(F.lit(value))).groupBy(key).agg(F.min("valid_from").alias("first_at"))
