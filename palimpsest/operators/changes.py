"""The change feed and the per-record chain of states that all strategies share.

A feed row is (id, op, change_ts, seq, tenant_id, user_id, <user fields>, set_fields, new_tenant_id); op is create,
update, delete, transfer or restore (of tables with the strategy none only). set_fields lists the fields that the row sets
(null: all), so an explicit NULL differs from a field that is left alone. A transfer gives the record to new_tenant_id;
its tenant_id, where it isn't null, is the tenant that must own it. Order is (change_ts, seq).

Everything is computed by windows over the record id: one shuffle on it, and functions
with constant state, so a record with very many changes sorts with spilling and is
never held in memory. Whether a row is accepted once its record has changed hands depends on all rows before it;
only records with transfers go through a fold over their sorted rows, which carries one record's owner at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import NONE, TableSpec
from .filters import quoted

_BEFORE = (Window.unboundedPreceding, -1)
_OPS = ("create", "update", "delete", "transfer", "restore")


def id_window(spec: TableSpec, *more: str) -> Window:
    return Window.partitionBy(spec.key, *more).orderBy("is_base", "change_ts", "seq", "op")


def with_base(base: DataFrame | None, feed: DataFrame, spec: TableSpec) -> DataFrame:
    """The feed with the touched records' current rows before it, as rows of op `base`; rows without an id are left out."""
    kinds = dict(feed.dtypes)
    tenant = kinds.get(spec.tenant_field, "string")
    wanted = {spec.tenant_field: tenant, "user_id": "string", "set_fields": "array<string>", "seq": "long", "new_tenant_id": tenant}
    for name, kind in wanted.items():
        if name not in kinds:
            feed = feed.withColumn(name, F.lit(None).cast(kind))
    feed = feed.where(F.col(spec.key).isNotNull())
    kinds = dict(feed.dtypes)
    instant = kinds["change_ts"]
    own = [("was_created_at", "created_at", instant), ("was_created_by", "created_by", kinds["user_id"]), ("was_updated_at", "updated_at", instant), ("was_updated_by", "updated_by", kinds["user_id"]),
           ("was_deleted_at", "deleted_at", instant), ("was_deleted_by", "deleted_by", kinds["user_id"]), ("was_valid_from", "valid_from", instant), ("was_version", "version", "int")]
    changes = feed.select(spec.key, "op", "change_ts", "seq", F.col(spec.tenant_field), "user_id", *map(quoted, spec.user_fields), "set_fields", F.col("new_tenant_id").cast(kinds[spec.tenant_field]).alias("new_tenant_id"), F.lit(1).alias("is_base"), *(F.lit(None).cast(k).alias(n) for n, _, k in own))
    if base is None:
        return changes
    have = set(base.columns)
    touched = base.join(feed.select(spec.key).distinct(), spec.key, "left_semi")
    # What was last: nothing older than it is applied any more.
    at = [F.col(c) for c in (("valid_from",) if "valid_from" in have else ("updated_at", "deleted_at")) if c in have]
    seeds = touched.select(
        spec.key, F.lit("base").alias("op"), (F.greatest(*at) if len(at) > 1 else at[0]).cast(instant).alias("change_ts"), F.lit(None).cast("long").alias("seq"),
        (F.col(spec.tenant_field) if spec.tenant_field in have else F.lit(None)).cast(kinds[spec.tenant_field]).alias(spec.tenant_field), F.lit(None).cast(kinds["user_id"]).alias("user_id"),
        *map(quoted, spec.user_fields), F.lit(None).cast("array<string>").alias("set_fields"), F.lit(None).cast(kinds[spec.tenant_field]).alias("new_tenant_id"), F.lit(0).alias("is_base"),
        *((F.col(c) if c in have else F.lit(None)).cast(k).alias(n) for n, c, k in own),
    )
    return seeds.unionByName(changes)


def by_windows(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds `reason`, why a row is rejected, null where it is accepted, and the tenants before and after it; of records that stay with their tenant.

    Acceptance depends on the first create, and on the deletes and restores so far; `dead` after a
    row is whether the last effective one of these was a delete.
    """
    w, before = id_window(spec), id_window(spec).rowsBetween(*_BEFORE)
    made = (F.col("op") == "base") | ((F.col("op") == "create") & (F.col(spec.tenant_field).isNotNull() if spec.multi_tenant else F.lit(True)))
    first_tenant = F.first(F.when(made, F.struct(spec.tenant_field)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))[spec.tenant_field]
    rows = rows.withColumn("exists", F.coalesce(F.max(F.when(made, True)).over(before), F.lit(False)))
    same = F.col(spec.tenant_field).eqNullSafe(first_tenant) if spec.multi_tenant else F.lit(True)
    rows = rows.withColumns({"tenant_ok": F.coalesce(same, F.lit(False)), "own_tenant": first_tenant, "old_tenant": first_tenant})
    floor = F.max(F.when(F.col("op") == "base", F.col("change_ts"))).over(w)
    rows = rows.withColumn("late", F.coalesce(F.col("change_ts") < floor, F.lit(False)) & (F.col("op") != "base"))
    ending = ("delete", "restore") if spec.strategy == NONE else ("delete",)
    ends = F.when(F.col("op") == "base", F.col("was_deleted_at").isNotNull()).when(F.col("exists") & F.col("tenant_ok") & ~F.col("late") & F.col("op").isin(*ending), F.col("op") == "delete")
    rows = rows.withColumn("ends", ends).withColumn("dead", F.coalesce(F.last("ends", ignorenulls=True).over(before), F.lit(False)))
    known = _OPS if spec.multi_tenant else [op for op in _OPS if op != "transfer"]
    reason = (
        F.when(F.col("op") == "base", None)
        .when(~F.col("op").isin(*known) | F.col("op").isNull(), "unknown op")
        .when(F.col("late"), "late")
        .when((F.col("op") == "create") & F.col("exists"), "exists")
        .when(F.col("op") == "create", F.when(F.col(spec.tenant_field).isNull(), "no tenant") if spec.multi_tenant else None)
        .when(~F.col("exists"), "not found")
        .when(F.col("op") == "transfer", "no tenant")  # others are judged by the fold
        .when(~F.col("tenant_ok"), "wrong tenant")
        .when((F.col("op") == "restore") & F.lit(spec.strategy != NONE), "no restore")
        .when((F.col("op") == "restore") & ~F.col("dead"), "not deleted")
        .when((F.col("op") != "restore") & F.col("dead"), "deleted")
    )
    return rows.withColumn("reason", reason.cast("string")).drop("exists", "tenant_ok", "late", "ends", "dead")


def _owners(spec: TableSpec):
    """Rows sorted by record and order, with `reason`, `own_tenant` and `old_tenant` instead of their last column; one record's state is carried at a time."""
    names = (spec.key, "op", "change_ts", spec.tenant_field, "new_tenant_id", "was_deleted_at")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, exists, owner, dead, floor = None, False, None, False, None
        for batch in batches:
            reasons, after, before = [], [], []
            for key, op, at, tenant, new, gone in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if key != now:
                    now, exists, owner, dead, floor = key, False, None, False, None
                old, why = owner, None
                if op == "base":
                    exists, owner, dead, floor = True, tenant, gone is not None, at
                elif op not in _OPS:
                    why = "unknown op"
                elif floor is not None and at is not None and at < floor:
                    why = "late"
                elif op == "create":
                    why = "exists" if exists else "no tenant" if tenant is None else None
                    if why is None:
                        exists, owner = True, tenant
                elif not exists:
                    why = "not found"
                elif op == "transfer":
                    why = "no tenant" if new is None else "wrong tenant" if tenant is not None and tenant != owner else "deleted" if dead else "same tenant" if new == owner else None
                    owner = owner if why else new
                elif tenant != owner:
                    why = "wrong tenant"
                elif op == "restore":
                    why = "no restore" if spec.strategy != NONE else None if dead else "not deleted"
                    dead = dead and why is not None
                elif dead:
                    why = "deleted"
                else:
                    dead = op == "delete"
                reasons.append(why)
                after.append(owner)
                before.append(old)
            kind = batch.schema.field(spec.tenant_field).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(after, kind), pa.array(before, kind), pa.array(reasons, pa.string())], [*batch.schema.names[:-1], "own_tenant", "old_tenant", "reason"])

    return fold


def by_fold(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """As by_windows, of any records: the owner changes with each accepted transfer.

    The window numbers rows for nobody: it demands what the fold rests on, a record's rows together and in order. A
    repartition demands nothing; after a join on the key it is left out, and adaptive execution then reads that join's shuffle as it lies.
    """
    kind = rows.schema[spec.tenant_field].dataType
    schema = T.StructType([*rows.schema.fields, T.StructField("own_tenant", kind), T.StructField("old_tenant", kind), T.StructField("reason", T.StringType())])
    return rows.withColumn("_n", F.row_number().over(id_window(spec))).mapInArrow(_owners(spec), schema)


def judged(base: DataFrame | None, feed: DataFrame, spec: TableSpec) -> list[DataFrame]:
    """The base's touched rows and the feed with `reason`, `own_tenant` and `old_tenant`: the records without transfers, and, where the feed may have any, those with."""
    rows = with_base(base, feed, spec)
    if not spec.multi_tenant or "new_tenant_id" not in feed.columns:
        return [by_windows(rows, spec)]
    movers = feed.where("op = 'transfer'").select(spec.key).distinct().withColumn("moves", F.lit(True))
    marked = rows.join(movers, spec.key, "left")
    return [by_windows(marked.where("moves is null").drop("moves"), spec), by_fold(marked.where("moves").drop("moves"), spec)]


def with_states(rows: DataFrame, spec: TableSpec, *more: str) -> DataFrame:
    """Each user field as it stands after the row, and `changed`: whether a field differs from the row before; rows that differ in `more` don't meet.

    A field is wrapped in a struct, so that an explicit NULL is a value.
    """
    w = id_window(spec, *more)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def state(f: str) -> Column:
        sets = F.col("op").isin("base", "create") | ((F.col("op") == "update") & (F.col("set_fields").isNull() | F.array_contains("set_fields", f)))
        return F.last(F.when(sets, F.struct(quoted(f).alias("v"))), ignorenulls=True).over(upto)["v"]

    out = rows.withColumns({f"new_{f}": state(f) for f in spec.user_fields})
    out = out.withColumns({f"old_{f}": F.lag(f"new_{f}").over(w) for f in spec.user_fields})
    changed = F.lit(False)
    for f in spec.user_fields:
        changed = changed | ~quoted(f"new_{f}").eqNullSafe(quoted(f"old_{f}"))
    return out.withColumn("changed", changed)


def united(parts: list[DataFrame], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every part finished on its own, so that each keeps its partitioning, then all of them."""
    return reduce(DataFrame.unionByName, map(finish, parts))


def rejected(rows: DataFrame, feed: DataFrame, spec: TableSpec) -> DataFrame:
    """The rejects among judged rows, and the feed's rows without an id; with new_tenant_id where the feed has it."""
    columns = [spec.key, "op", "change_ts", "seq", spec.tenant_field, *(("new_tenant_id",) if "new_tenant_id" in feed.columns else ()), "reason"]
    found = rows.where("reason is not null").select(*columns)
    kinds = {f.name: f.dataType for f in found.schema}
    nameless = feed.where(F.col(spec.key).isNull())
    return found.unionByName(nameless.select(*((F.col(c) if c in feed.columns else F.lit("no id") if c == "reason" else F.lit(None)).cast(kinds[c]).alias(c) for c in columns)))


def stable_uuid(*parts: Column) -> Column:
    """A UUID-formatted hash of the parts: the same on every attempt."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def create_defaults(df: DataFrame, spec: TableSpec, natural_key: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Missing ids from the natural key, missing values from the defaults."""
    out = df.withColumn(spec.key, F.coalesce(F.col(spec.key), stable_uuid(*map(quoted, natural_key))) if spec.key in df.columns else stable_uuid(*map(quoted, natural_key)))
    return out.withColumns({c: F.coalesce(quoted(c), v) if c in df.columns else v for c, v in (defaults or {}).items()})


def force_tenant(df: DataFrame, tenant: Column | str, tenant_field: str = "tenant_id") -> DataFrame:
    """Strict scope on writing: every row gets the tenant."""
    return df.withColumn(tenant_field, F.lit(tenant) if isinstance(tenant, str) else tenant)


def check_tenant(df: DataFrame, tenants: list, tenant_field: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """Permissive scope on writing: (rows of the tenants, others with a reason)."""
    inside = F.coalesce(F.col(tenant_field).isin(*tenants), F.lit(False))
    return df.where(inside), df.where(~inside).withColumn("reason", F.when(F.col(tenant_field).isNull(), "no tenant").otherwise("outside scope"))
