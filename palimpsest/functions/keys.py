"""Keys and metadata of stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_keys(m: Column) -> Column:
    """Keys that every store accepts: `-` and `.` become `_`; values become text. Later ones of clashing keys are dropped."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(F.translate(e["key"], "-.", "__").alias("key"), e["value"].cast("string").alias("value")))
    first = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda p: p["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def metadata_keys_back(m: Column) -> Column:
    """`_` to `-`; which character was there before is lost."""
    return F.transform_keys(m, lambda k, v: F.translate(k, "_", "-"))


def object_key(key: Column) -> Column:
    """Without leading slashes; NULL where the key's segments climb out of the root at any point."""
    bare = F.regexp_replace(key, "^/+", "")
    depth = F.aggregate(
        F.split(bare, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda a, s: F.struct(
            (a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(a["low"], a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
        lambda a: a["low"],
    )
    return F.when(depth >= 0, bare)


def with_prefix(key: Column, prefix: str) -> Column:
    p = prefix.strip("/")
    return F.concat(F.lit(f"{p}/" if p else ""), F.regexp_replace(key, "^/+", ""))


def without_prefix(key: Column, prefix: str) -> Column:
    p = prefix.strip("/")
    return F.when(key.startswith(f"{p}/"), F.substring(key, F.lit(len(p) + 2), F.length(key))).otherwise(key) if p else key
