"""Values as JSON text, as an audit trail stores them, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_timestamp(c: Column, zoned: bool = False) -> Column:
    """ISO-8601 with microseconds only where they are not zero."""
    whole, parts = (F.date_format(c, f) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(parts)
    return F.concat(text, F.lit("+00:00")) if zoned else text


def _quoted(c: Column) -> Column:
    """A text as a JSON string, control characters escaped; NULL stays NULL."""
    whole = F.to_json(F.struct(c.alias("v")))  # {"v":"..."}
    return F.when(c.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def audit_json(c: Column, kind: str) -> Column:
    """JSON text of a column of the given type; NULL stays NULL. Decimals are strings that keep their scale."""
    if kind == "string":
        return _quoted(c)
    if kind.startswith("decimal"):
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    if kind == "binary":
        return F.concat(F.lit('"'), F.lower(F.hex(c)), F.lit('"'))
    if kind == "date":
        return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit('"'))
    if kind.startswith("timestamp"):
        return F.concat(F.lit('"'), iso_timestamp(c, zoned=kind == "timestamp"), F.lit('"'))
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if kind in ("float", "double"):  # JSON has no NaN and no infinity: these are strings
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    return c.cast("string")


def audit_value(text: Column, kind: str) -> Column:
    """The typed value of audit_json's text."""
    bare = F.regexp_extract(text, r'(?s)^"(.*)"$', 1)
    if kind == "string":
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    if kind == "binary":
        return F.unhex(bare)
    if kind.startswith(("decimal", "date", "timestamp")):
        return bare.cast(kind)
    if kind in ("float", "double"):
        return F.replace(text, F.lit('"'), F.lit("")).cast(kind)
    if kind.startswith(("array", "map", "struct")):
        return F.from_json(text, kind)
    return text.cast(kind)


def json_encode(c: Column, kind: str) -> Column:
    """A stored JSON column: text as it is, anything else as JSON."""
    return c if kind == "string" else F.to_json(c, {"ignoreNullFields": "false"})


def json_decode(c: Column, schema: str | T.DataType) -> Column:
    """Read a stored JSON column: (parsed value, raw text where it can't be parsed)."""
    parsed = F.from_json(c, schema)
    valid = F.try_parse_json(c).isNotNull()
    return F.struct(F.when(valid, parsed).alias("value"), F.when(~valid, c).alias("raw"))
