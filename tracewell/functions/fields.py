"""Columns that pull named values out of a parsed trace event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(nodes: Column, name: str) -> Column:
    """Value of the first node called ``name``; NULL when there is none."""
    return F.get(nodes["value"], (F.array_position(nodes["_name"], name) - 1).cast("int"))


def data_value(name: str, event: str = "event") -> Column:
    return _named(F.col(event)["data"], name)


def action_value(name: str, event: str = "event") -> Column:
    return _named(F.col(event)["action"], name)
