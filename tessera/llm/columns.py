"""Columns of a caller's table under whatever names they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of just this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it differ from every column of df (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(df: DataFrame) -> Column:
    """A row of df as one struct."""
    return F.struct(*(quoted(c) for c in df.columns))
