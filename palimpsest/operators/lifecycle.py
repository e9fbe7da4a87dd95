"""Retention, migration between strategies, and schema evolution."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import strict_cast
from ..functions.jsonval import audit_value
from ..spec import SCD2, TableSpec
from .audit import audit_rows
from .filters import quoted
from .paging import rank_versions


def archive_audit(audit: DataFrame, cutoff: Any) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to move to the archive)."""
    old = F.col("changed_at") < F.lit(cutoff)
    return audit.where(~old), audit.where(old)


def archive_versions(table: DataFrame, keep: int = 10, tenant: Any = None, tenant_field: str = "tenant_id", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the newest versions of each id, the others), of one tenant where given; other tenants' rows all stay."""
    ranked = rank_versions(table if tenant is None else table.where(F.col(tenant_field) == F.lit(tenant)), key)
    kept = ranked.where(F.col("rn") <= keep).drop("rn")
    if tenant is not None:
        kept = kept.unionByName(table.where(~F.col(tenant_field).eqNullSafe(F.lit(tenant))))
    return kept, ranked.where(F.col("rn") > keep).drop("rn")


def prune_versions(table: DataFrame, keep: int = 10, tenant: Any = None, tenant_field: str = "tenant_id", key: str = "id") -> DataFrame:
    return archive_versions(table, keep, tenant, tenant_field, key)[0]


def purge_deleted(table: DataFrame, cutoff: Any, spec: TableSpec, tenant: Any = None, tombstone_only: bool = False) -> DataFrame:
    """Remove records deleted before the cutoff; of versioned tables all their versions, unless tombstone_only."""
    gone = F.coalesce(F.col("deleted_at") < F.lit(cutoff), F.lit(False))
    if tenant is not None:
        gone = gone & (F.col(spec.tenant_field) == F.lit(tenant))
    if spec.strategy != SCD2 or tombstone_only:
        return table.where(~F.coalesce(gone, F.lit(False)))
    return table.join(table.where(gone).select(spec.key).distinct(), spec.key, "left_anti").select(*table.columns)


def add_temporal(df: DataFrame, spec: TableSpec, instant: Any, backfill_tenant: Any = None, from_created: bool = False) -> DataFrame:
    """Give an existing table the columns that its strategy and features need."""
    out = df
    if spec.multi_tenant:
        filled = F.lit(backfill_tenant)
        out = out.withColumn(spec.tenant_field, F.coalesce(F.col(spec.tenant_field), filled) if spec.tenant_field in df.columns else filled)
    start = F.col("created_at") if from_created and "created_at" in df.columns else F.lit(instant)
    added: dict[str, Column] = {}
    if spec.soft_delete:
        added |= {"deleted_at": F.lit(None).cast("timestamp_ntz"), "deleted_by": F.lit(None).cast("string")}
    if spec.strategy == SCD2:
        added |= {"valid_from": start, "valid_to": F.lit(None).cast("timestamp_ntz"), "version": F.lit(1)}
    return out.withColumns({k: v for k, v in added.items() if k not in df.columns})


def add_audit(df: DataFrame, spec: TableSpec, instant: Any, user: str | None = None, backfill_tenant: Any = None) -> dict[str, DataFrame]:
    """Give an existing table the audited form: its columns, and an audit trail that starts with an INSERT row for each field as it stands."""
    table = add_temporal(df, spec, instant, backfill_tenant)
    chain = table.select(
        spec.key, F.lit("create").alias("op"), F.lit(instant).alias("change_ts"), F.lit(0).cast("long").alias("seq"), F.lit(user).cast("string").alias("user_id"), *((F.col(spec.tenant_field).alias("own_tenant"), F.col(spec.tenant_field).alias("old_tenant")) if spec.multi_tenant else ()),
        *(quoted(f).alias(f"new_{f}") for f in spec.user_fields), *(F.lit(None).cast(table.schema[f].dataType).alias(f"old_{f}") for f in spec.user_fields),
    )
    return {"table": table, "audit": audit_rows(chain, spec)}


def audit_to_feed(audit: DataFrame, spec: TableSpec, kinds: dict[str, str]) -> DataFrame:
    """The change feed that an audit trail records: one row for each transaction; of a transfer with the tenants before and after it."""
    tenant = (spec.tenant_field,) if spec.multi_tenant else ()
    value = lambda f: F.first(F.when(F.col("field_name") == f, F.struct("old_value", "new_value")), ignorenulls=True).alias(f"_{f}")
    wide = audit.groupBy("record_id", "changed_at", "seq", "transaction_id", "changed_by", "operation", *tenant).agg(*(value(f) for f in (*spec.user_fields, *tenant)))
    sets = F.filter(F.array(*(F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in spec.user_fields)), lambda x: x.isNotNull())
    operation = F.col("operation")
    op = F.when(operation == "INSERT", "create").when(operation == "DELETE", "delete").when(operation == "TRANSFER", "transfer").otherwise("update")
    owner: tuple[Column, ...] = ()
    if tenant:
        kind, moved = dict(audit.dtypes)[spec.tenant_field], F.col(f"_{spec.tenant_field}")
        owner = (F.when(operation == "TRANSFER", audit_value(moved["old_value"], kind)).otherwise(F.col(spec.tenant_field)).alias(spec.tenant_field), audit_value(moved["new_value"], kind).alias("new_tenant_id"))
    return wide.select(
        F.col("record_id").alias(spec.key), op.alias("op"), F.col("changed_at").alias("change_ts"), "seq", *owner,
        F.col("changed_by").alias("user_id"), *(audit_value(F.col(f"_{f}")["new_value"], kinds[f]).alias(f) for f in spec.user_fields), sets.alias("set_fields"),
    )


def versions_to_audit(table: DataFrame, spec: TableSpec) -> DataFrame:
    """The audit trail that versions record: INSERT rows of a first version, UPDATE rows of changed fields, the TRANSFER row of another tenant, the row of a tombstone.

    `seq` is the version. The rows are those of audit_rows: versions are read as the chain of states
    that they are. A version that changes tenant and fields is a transfer, then an update.
    """
    w = Window.partitionBy(spec.key).orderBy("version")
    moved = ~F.col("own_tenant").eqNullSafe(F.col("old_tenant")) if spec.multi_tenant else F.lit(False)
    changed = F.lit(False)
    for f in spec.user_fields:
        changed = changed | ~quoted(f"new_{f}").eqNullSafe(quoted(f"old_{f}"))
    later = F.filter(F.array(F.when(moved, F.lit("transfer")), F.when(changed | ~moved, F.lit("update"))), lambda x: x.isNotNull())
    ops = F.when(F.col("version") == 1, F.array(F.lit("create"))).when(F.col("deleted_at").isNotNull(), F.array(F.lit("delete"))).otherwise(later)
    owners = (F.col(spec.tenant_field).alias("own_tenant"), F.lag(spec.tenant_field).over(w).alias("old_tenant")) if spec.multi_tenant else ()
    states = table.select(
        spec.key, "version", "deleted_at", "created_by", "updated_by", "deleted_by", F.col("valid_from").alias("change_ts"), F.col("version").cast("long").alias("seq"), *owners,
        *(quoted(f).alias(f"new_{f}") for f in spec.user_fields), *(F.lag(quoted(f)).over(w).alias(f"old_{f}") for f in spec.user_fields),
    )
    chain = states.withColumn("op", F.explode(ops))
    by = F.when(F.col("op") == "create", F.col("created_by")).when(F.col("op") == "delete", F.col("deleted_by")).otherwise(F.col("updated_by"))
    return audit_rows(chain.withColumn("user_id", by), spec)


def scd2_to_audited(table: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """Current records, the audit trail that their versions record, and the versions themselves for the archive."""
    drop = ("valid_from", "valid_to", "version")
    return {"table": table.where("valid_to is null").drop(*drop), "audit": versions_to_audit(table, spec), "archive": table.where("valid_to is not null")}


def scd2_to_none(table: DataFrame, spec: TableSpec) -> DataFrame:
    """Live records without the temporal columns."""
    return table.where("valid_to is null and deleted_at is null").drop("valid_from", "valid_to", "version", "deleted_at", "deleted_by")


def schema_changes(current: T.StructType, desired: T.StructType, allow_destructive: bool = False) -> list[tuple[str, str]]:
    """(kind, column) of what evolve would do: add, drop, type, not_null."""
    have, want = {f.name: f for f in current}, {f.name: f for f in desired}
    out = [("add", c) for c in want if c not in have]
    out += [("drop", c) for c in have if c not in want and allow_destructive]
    for c in want:
        if c in have:
            if have[c].dataType != want[c].dataType:
                out.append(("type", c))
            if have[c].nullable and not want[c].nullable:
                out.append(("not_null", c))
    return out


def evolve_table(df: DataFrame, desired: T.StructType, defaults: dict[str, Any] | None = None, allow_destructive: bool = False) -> DataFrame:
    """Bring data to the desired schema in one projection.

    A new column gets its default or NULL; one without NULLs, new or not, needs a default (ValueError);
    columns that aren't desired stay, unless allow_destructive.
    """
    defaults = defaults or {}
    changes = schema_changes(df.schema, desired, allow_destructive)
    for kind, c in changes:
        if kind == "not_null" and c not in defaults:
            raise ValueError(f"{c} becomes NOT NULL without a default")
        if kind == "add" and not desired[c].nullable and c not in defaults:
            raise ValueError(f"{c} is added NOT NULL without a default")
    have = {f.name: f for f in df.schema}
    columns = []
    for f in desired:
        c = strict_cast(quoted(f.name), f.dataType.simpleString(), have[f.name].dataType.simpleString()) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in defaults and (f.name not in have or ("not_null", f.name) in changes):
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(c.alias(f.name))
    if not allow_destructive:
        columns += [quoted(c) for c in have if c not in desired.fieldNames()]
    return df.select(*columns)
