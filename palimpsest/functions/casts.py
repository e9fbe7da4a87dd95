"""Bulk text conversions and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that are booleans.
TRUE_TEXTS = ("t", "true", "1", "yes", "y")
FALSE_TEXTS = ("f", "false", "0", "no", "n")

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _invalid(c: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a {kind}: "), c.cast("string")))


def parse_bool(c: Column) -> Column:
    """t true 1 yes y / f false 0 no n in any case; NULL and '' are NULL; anything else fails the job."""
    low = F.lower(F.trim(c))
    return F.when(c.isNull() | (c == ""), None).when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False).otherwise(_invalid(c, "boolean").cast("boolean"))


def strict_cast(c: Column, kind: str, source: str = "string") -> Column:
    """Text to a type: NULL and '' become NULL, anything invalid fails the job. Other sources are plainly cast."""
    if source == kind:
        return c
    if source != "string":
        return c.cast(kind)
    if kind == "boolean":
        return parse_bool(c)
    if kind == "uuid":
        return F.when(c.isNull() | (c == ""), None).when(c.rlike(_UUID), F.lower(c)).otherwise(_invalid(c, "uuid").cast("string"))
    if kind == "json":
        return F.when(c.isNull() | (c == ""), "[]").when(F.try_parse_json(c).isNotNull(), c).otherwise(_invalid(c, "json").cast("string"))
    value = c.try_cast(kind)
    return F.when(c.isNull() | (c == ""), None).when(value.isNotNull(), value).otherwise(_invalid(c, kind).cast(kind))


def array_contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def array_overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def json_list_to_array(c: Column, element: str = "string") -> Column:
    """A JSON list column as a native array."""
    return F.transform(F.from_json(c, "array<string>"), lambda x: x.cast(element))
