"""Operators on tables of records; importing this registers the three strategies."""

from . import audit, current, scd2

__all__ = ["audit", "current", "scd2"]
