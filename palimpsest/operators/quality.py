"""Constraint checks that a database would enforce, as jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonval import audit_json
from ..spec import TableSpec
from .filters import quoted
from .stats import duplicates


def _report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) of all checks in one pass."""
    counted = df.agg(F.array(*(F.struct(F.lit(n).alias("rule"), F.count(F.when(c, 1)).alias("violations")) for n, c in checks.items())).alias("r"))
    return counted.select(F.explode("r").alias("r")).select("r.*")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return _report(df, {c: quoted(c).isNull() for c in columns})


def check_range(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rules are what must hold; as in a database, an unknown result is no violation."""
    return _report(df, {n: F.coalesce(~rule, F.lit(False)) for n, rule in rules.items()})


def check_length(df: DataFrame, columns: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Text lengths within (least, most)."""
    return _report(df, {c: F.coalesce(~F.length(quoted(c)).between(a, b), F.lit(False)) for c, (a, b) in columns.items()})


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(df, keys)


def check_scd2_timeline(table: DataFrame, key: str = "id") -> DataFrame:
    """(id, version, problem): gaps in versions, more than one open row, periods that don't meet, versions after a tombstone."""
    w = Window.partitionBy(key).orderBy("version")
    marked = table.withColumns({"n": F.row_number().over(w), "next_from": F.lead("valid_from").over(w), "gone": F.lag(F.col("deleted_at").isNotNull()).over(w), "next_version": F.lead("version").over(w)})
    problem = (
        F.when(F.col("n") != F.col("version"), "version gap")
        .when(F.col("next_version").isNotNull() & F.col("valid_to").isNull(), "open before the last")
        .when(F.col("next_version").isNull() & F.col("valid_to").isNotNull(), "no open version")
        .when(~F.coalesce(F.col("valid_to") == F.col("next_from"), F.col("next_version").isNull()), "periods don't meet")
        .when(F.coalesce(F.col("gone"), F.lit(False)), "version after tombstone")
    )
    return marked.select(key, "version", problem.alias("problem")).where("problem is not null")


def check_audit_consistency(table: DataFrame, audit: DataFrame, spec: TableSpec) -> DataFrame:
    """(record_id, field_name, problem): a last new value that isn't the record's, an old value that isn't the one before."""
    own = audit.where(F.col("field_name").isin(*spec.user_fields))
    w = Window.partitionBy("record_id", "field_name").orderBy("changed_at", "seq", "audit_id")
    broken = own.withColumns({"before": F.lag("new_value").over(w), "n": F.row_number().over(w)}).where("n > 1 and not (old_value <=> before)")
    last = own.where("operation != 'DELETE'").groupBy("record_id", "field_name").agg(F.max_by(F.struct("new_value"), F.struct("changed_at", "seq", "audit_id")).alias("v"))
    kinds = dict(table.dtypes)
    stored = table.select(F.col(spec.key).alias("record_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), audit_json(quoted(f), kinds[f]).alias("stored")) for f in spec.user_fields))).alias("e")).select("record_id", "e.*")
    differs = last.join(stored, ["record_id", "field_name"]).where("not (v.new_value <=> stored)")
    return broken.select("record_id", "field_name", F.lit("old value").alias("problem")).unionByName(differs.select("record_id", "field_name", F.lit("last value").alias("problem")))


def tenant_leaks(df: DataFrame, tenants: list, tenant_field: str = "tenant_id") -> DataFrame:
    return df.where(~F.coalesce(F.col(tenant_field).isin(*tenants), F.lit(False)))
