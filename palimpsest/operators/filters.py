"""Predicates and projections: dictionary filters, tenant scope, visibility, time travel."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SCD2, TableSpec

#: Lists up to this length become IN; longer ones are joined.
MOST_IN = 1000


def quoted(name: str) -> Column:
    """A column by its exact name, reserved words and dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def condition(filters: Mapping[str, Any], operator: str = "AND") -> Column:
    """value: equality, None: IS NULL, list or tuple: IN (an empty one is an error), joined by AND or OR."""
    if operator.upper() not in ("AND", "OR"):
        raise ValueError(f"operator must be AND or OR, not {operator!r}")
    parts = []
    for name, value in filters.items():
        if value is None:
            parts.append(quoted(name).isNull())
        elif isinstance(value, (list, tuple, set)):
            if not value:
                raise ValueError(f"empty list for {name}")
            parts.append(quoted(name).isin(*value))
        else:
            parts.append(quoted(name) == F.lit(value))
    return reduce(and_ if operator.upper() == "AND" else or_, parts) if parts else F.lit(True)


def filter_by(df: DataFrame, filters: Mapping[str, Any], operator: str = "AND") -> DataFrame:
    return df.where(condition(filters, operator))


def filter_allowed(df: DataFrame, filters: Mapping[str, Any], allowed: Iterable[str], operator: str = "AND") -> DataFrame:
    """filter_by over columns of an allow-list; others are an error."""
    if unknown := set(filters) - set(allowed):
        raise ValueError(f"columns not allowed: {sorted(unknown)}")
    return filter_by(df, filters, operator)


def tenant_scope(df: DataFrame, tenant_field: str = "tenant_id", tenant_id: Any = None, tenant_ids: Sequence | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of one tenant (strict) or of several (permissive); a tenant key among the user's filters wins."""
    if tenant_id is not None and tenant_ids is not None:
        raise ValueError("give tenant_id or tenant_ids, not both")
    if tenant_ids is not None and not tenant_ids:
        raise ValueError("tenant_ids is empty")
    if filters and tenant_field in filters:
        return filter_by(df, filters)
    scoped = filter_by(df, filters or {})
    if tenant_id is not None:
        return scoped.where(quoted(tenant_field) == F.lit(tenant_id))
    if tenant_ids is None:
        return scoped
    wanted = list(dict.fromkeys(tenant_ids))
    if len(wanted) <= MOST_IN:
        return scoped.where(quoted(tenant_field).isin(*wanted))
    listed = df.sparkSession.createDataFrame([(x,) for x in wanted], [tenant_field])
    return scoped.join(listed, tenant_field, "left_semi").select(*df.columns)


def select_columns(df: DataFrame, columns: Sequence[str], where: Column | None = None, order_by: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df if where is None else df.where(where)
    out = out.orderBy(*order_by) if order_by else out
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return out.select(*map(quoted, columns))


def live(spec: TableSpec, include_deleted: bool = False) -> Column:
    """Which rows are the live state."""
    out = F.lit(True)
    if spec.soft_delete and not include_deleted:
        out = out & F.col("deleted_at").isNull()
    if spec.strategy == SCD2:
        out = out & F.col("valid_to").isNull()
    return out


def current_rows(df: DataFrame, spec: TableSpec, include_deleted: bool = False) -> DataFrame:
    return df.where(live(spec, include_deleted))


def as_of(df: DataFrame, instant: Any, include_deleted: bool = False) -> DataFrame:
    """The version of every id that was valid at the instant: one range predicate, no shuffle."""
    t = F.lit(instant)
    out = df.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return out if include_deleted else out.where(F.col("deleted_at").isNull() | (F.col("deleted_at") > t))


def get_version(df: DataFrame, record_id: Any, version: int, key: str = "id") -> DataFrame:
    return df.where((quoted(key) == F.lit(record_id)) & (F.col("version") == version))


def get_versions(df: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The versions that `wanted` (key, version) lists."""
    return df.join(wanted.select(key, "version"), [key, "version"], "left_semi").select(*df.columns)


def drop_computed(df: DataFrame, computed: Iterable[str]) -> DataFrame:
    """Columns derived on reading are not stored."""
    return df.drop(*computed)


def with_computed(df: DataFrame, computed: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(computed))


def escape_like(pattern: str) -> str:
    """A literal for LIKE: backslash, percent and underscore escaped (a bracket is not special here)."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_literal(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains the text literally."""
    return df.where(quoted(column).contains(text))


def is_open(versions: DataFrame) -> Column:
    """Which rows are the last of their record: by the partition of a table that has one for them, else by valid_to."""
    return F.col("is_open") if "is_open" in versions.columns else F.col("valid_to").isNull()
