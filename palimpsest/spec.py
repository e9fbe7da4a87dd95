"""What a table is: its key, its strategy, and which columns belong to which group."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NONE, AUDITED, SCD2 = "none", "copy_on_change", "scd2"


@dataclass(frozen=True)
class TableSpec:
    """A table of records: `fields` are the user's columns, the rest follows from strategy and features."""

    name: str
    fields: tuple[str, ...]
    strategy: str = SCD2
    soft_delete: bool = True
    multi_tenant: bool = True
    tenant_field: str = "tenant_id"
    key: str = "id"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if self.strategy == SCD2:
            object.__setattr__(self, "soft_delete", True)

    @property
    def base_fields(self) -> tuple[str, ...]:
        return (self.key, "created_at", "updated_at", "created_by", "updated_by")

    @property
    def system_fields(self) -> tuple[str, ...]:
        return (
            *self.base_fields,
            *((self.tenant_field,) if self.multi_tenant else ()),
            *(("deleted_at", "deleted_by") if self.soft_delete else ()),
            *(("valid_from", "valid_to", "version") if self.strategy == SCD2 else ()),
        )

    @property
    def user_fields(self) -> tuple[str, ...]:
        return tuple(f for f in self.fields if f not in self.system_fields)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.key, *self.user_fields, *(f for f in self.system_fields if f != self.key))

    def full_schema(self, user: T.StructType) -> T.StructType:
        """The stored schema for these user columns."""
        kinds = {"version": T.IntegerType(), **{c: T.TimestampType() for c in ("created_at", "updated_at", "deleted_at", "valid_from", "valid_to")}}
        needed = {self.key, "created_at", "updated_at", self.tenant_field, "valid_from", "version"}
        given = {f.name: f for f in user.fields}
        return T.StructType([given[c] if c in given else T.StructField(c, kinds.get(c, T.StringType()), c not in needed) for c in self.columns])


#: strategy -> function (base or None, feed, spec) -> dict of DataFrames; see register_strategy.
STRATEGIES: dict[str, Callable | None] = {NONE: None, AUDITED: None, SCD2: None}


def register_strategy(name: str, apply: Callable[[DataFrame | None, DataFrame, TableSpec], dict[str, DataFrame]]) -> None:
    STRATEGIES[name] = apply


def get_strategy(name: str) -> Callable:
    from . import operators  # noqa: F401  registers the built-in ones

    if STRATEGIES.get(name) is None:
        raise ValueError(f"unknown strategy {name!r}")
    return STRATEGIES[name]


_PLAIN_TYPES = {
    "uuid": T.StringType(), "text": T.StringType(), "string": T.StringType(), "varchar": T.StringType(), "integer": T.IntegerType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "boolean": T.BooleanType(), "double precision": T.DoubleType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "date": T.DateType(), "time": T.StringType(),
    "interval": T.DayTimeIntervalType(), "bytea": T.BinaryType(), "binary": T.BinaryType(), "json": T.StringType(), "jsonb": T.StringType(),
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a database type name such as `NUMERIC(10,2)`, `VARCHAR(50)` or `TEXT[]`; anything unknown is text."""
    plain = name.strip().lower()
    if plain.endswith("[]"):
        return T.ArrayType(parse_type(plain[:-2]))
    if m := re.fullmatch(r"(?:numeric|decimal)(?:\((\d+)(?:,\s*(\d+))?\))?", plain):
        return T.DecimalType(int(m[1]), int(m[2] or 0)) if m[1] else T.DecimalType(15, 2)
    return _PLAIN_TYPES.get(re.sub(r"\(.*\)", "", plain).strip(), T.StringType())
