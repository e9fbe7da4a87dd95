"""Audited tables: field-level change rows, their queries, and rebuilding a past state from them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonval import audit_json, audit_value, iso_timestamp
from ..spec import AUDITED, TableSpec, register_strategy
from .changes import rejected, stable_uuid
from .current import change_log, state_of
from .filters import quoted
from .scd2 import transfer_feed


def audit_rows(chain: DataFrame, spec: TableSpec) -> DataFrame:
    """INSERT rows for every user field of a create, UPDATE rows for changed fields, and the delete's rows.

    Fields are compared before anything is exploded. A soft delete has one row for deleted_at; a hard
    one has a DELETE row for each user field. Rows of one change share a transaction_id; `seq` is the
    change's place among those of one instant. A transfer has one TRANSFER row, under the new tenant.
    """
    kinds = dict(chain.dtypes)
    entry = lambda f, old, new: F.struct(F.lit(f).alias("field_name"), old.alias("old_value"), new.alias("new_value"))
    none = F.lit(None).cast("string")
    new = {f: audit_json(quoted(f"new_{f}"), kinds[f"new_{f}"]) for f in spec.user_fields}
    old = {f: audit_json(quoted(f"old_{f}"), kinds[f"old_{f}"]) for f in spec.user_fields}
    insert = F.array(*(entry(f, none, new[f]) for f in spec.user_fields))
    update = F.filter(F.array(*(F.when(~quoted(f"new_{f}").eqNullSafe(quoted(f"old_{f}")), entry(f, old[f], new[f])) for f in spec.user_fields)), lambda e: e.isNotNull())
    if spec.soft_delete:
        delete = F.array(entry("deleted_at", none, F.concat(F.lit('"'), iso_timestamp(F.col("change_ts")), F.lit('"'))))
    else:
        delete = F.array(*(entry(f, new[f], none) for f in spec.user_fields))
    moved = F.array()
    if spec.multi_tenant:
        kind = kinds["own_tenant"]
        moved = F.array(entry(spec.tenant_field, audit_json(F.col("old_tenant"), kind), audit_json(F.col("own_tenant"), kind)))
    op = F.col("op")
    rows = chain.where(op.isin("create", "update", "delete", *(("transfer",) if spec.multi_tenant else ()))).select(
        F.col(spec.key).alias("record_id"), *((F.col("own_tenant").alias(spec.tenant_field),) if spec.multi_tenant else ()),
        F.when(op == "create", "INSERT").when(op == "update", "UPDATE").when(op == "transfer", "TRANSFER").otherwise("DELETE").alias("operation"),
        F.col("change_ts").alias("changed_at"), F.col("user_id").alias("changed_by"), "seq",
        F.explode(F.when(op == "create", insert).when(op == "update", update).when(op == "transfer", moved).otherwise(delete) if spec.multi_tenant else F.when(op == "create", insert).when(op == "update", update).otherwise(delete)).alias("e"),
    )
    tenant = (spec.tenant_field,) if spec.multi_tenant else ()
    return rows.select(
        stable_uuid(F.col("record_id"), F.col("e.field_name"), F.col("changed_at"), F.col("seq"), F.col("operation")).alias("audit_id"), "record_id", *tenant, "e.*", "operation",
        "changed_at", "changed_by", stable_uuid(F.col("record_id"), F.col("changed_at"), F.col("seq")).alias("transaction_id"), F.lit(None).cast("string").alias("metadata"), "seq",
    )


def apply_audited(base: DataFrame | None, feed: DataFrame, spec: TableSpec, keep: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Apply a feed: {"table": current state, "audit": new audit rows, "rejects": ...}; keep writes the change log, where all three are read."""
    log = change_log(base, feed, spec)
    log = keep(log) if keep else log
    return {"table": state_of(log, base, feed, spec), "audit": audit_rows(log.where("ok"), spec), "rejects": rejected(log, feed, spec)}


register_strategy(AUDITED, apply_audited)


def audit_transfer(table: DataFrame, requests: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """Give records to other tenants: the new table, a TRANSFER row each under the new tenant, and rejects; requests as for transfer_ownership."""
    out = apply_audited(table, transfer_feed(table, requests, spec), spec)
    return {"table": out["table"].select(*table.columns), "audit": out["audit"], "rejects": out["rejects"].select(spec.key, "new_tenant_id", "reason")}


def audit_history(audit: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All entries of the records that `ids` (record_id) lists, oldest first."""
    out = audit if ids is None else audit.join(ids.select("record_id").distinct(), "record_id", "left_semi").select(*audit.columns)
    return out.orderBy("record_id", "changed_at", "seq", "field_name")


def field_history(audit: DataFrame, field: str, ids: DataFrame | None = None) -> DataFrame:
    return audit_history(audit.where(F.col("field_name") == field), ids)


def changes_by_user(audit: DataFrame, user: Any, start: Any = None, end: Any = None, limit: int = 100) -> DataFrame:
    """A user's changes, newest first."""
    out = audit.where(F.col("changed_by") == F.lit(user))
    out = out if start is None else out.where(F.col("changed_at") >= F.lit(start))
    out = out if end is None else out.where(F.col("changed_at") <= F.lit(end))
    return out.orderBy(F.desc("changed_at"), "record_id", "field_name").limit(limit)


def changes_in_range(audit: DataFrame, start: Any, end: Any, operation: str | None = None) -> DataFrame:
    out = audit.where(F.col("changed_at").between(F.lit(start), F.lit(end)))
    out = out if operation is None else out.where(F.col("operation") == operation)
    return out.orderBy("changed_at", "record_id", "field_name")


def reconstruct_at(table: DataFrame, audit: DataFrame, instant: Any, spec: TableSpec, with_tenant: bool = False) -> DataFrame:
    """Every record's user fields (and its tenant) at the instant: of each field changed later, the earliest later change's old value (by instant, then seq).

    Records created after the instant are left out; so are those deleted by then. Without soft delete, records that were
    deleted later are there as well: their DELETE rows hold every field, and a record whose first later
    entry is not its INSERT was there at the instant.
    """
    t = F.lit(instant)
    place = F.struct("changed_at", "seq", "audit_id")
    fields = [*spec.user_fields, *(("deleted_at",) if spec.soft_delete else ()), *((spec.tenant_field,) if with_tenant else ())]
    undo = audit.where(F.col("changed_at") > t).groupBy("record_id", "field_name").agg(F.min(F.struct(place.alias("place"), "operation", "old_value")).alias("o"))
    wide = undo.groupBy(F.col("record_id").alias(spec.key)).agg(F.min_by("o.operation", "o.place").alias("next_operation"), *(F.first(F.when(F.col("field_name") == f, F.col("o")), ignorenulls=True).alias(f"undo_{f}") for f in fields))
    there = F.col("created_at") <= t
    if spec.soft_delete:
        joined = table.where(there).join(wide, spec.key, "left").where(F.col("deleted_at").isNull() | (F.col("deleted_at") > t))
    else:
        joined = table.join(wide, spec.key, "full").where(F.coalesce(F.col("next_operation") != "INSERT", there))
    kinds = dict(table.dtypes)
    return joined.select(spec.key, *(F.when(F.col(f"undo_{f}").isNotNull(), audit_value(F.col(f"undo_{f}.old_value"), kinds[f])).otherwise(quoted(f)).alias(f) for f in fields if f != "deleted_at"))


def change_frequency(audit: DataFrame, by_field: bool = False) -> DataFrame:
    return audit.groupBy("record_id", *(("field_name",) if by_field else ())).agg(F.count(F.lit(1)).alias("n_changes"))


def most_changed_fields(audit: DataFrame, limit: int = 10) -> DataFrame:
    """Of each record, the fields with the most changes."""
    counts = change_frequency(audit, by_field=True)
    w = Window.partitionBy("record_id").orderBy(F.desc("n_changes"), "field_name")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def transactions(audit: DataFrame) -> DataFrame:
    """The fields that each transaction changed; a transaction is one change of one record, so its list is bounded by the fields."""
    return audit.groupBy("transaction_id", "record_id", "changed_at").agg(F.sort_array(F.collect_list("field_name")).alias("fields"))
