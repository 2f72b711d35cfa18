"""Names of columns that an operator adds beside those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, name: str, *others: str) -> str:
    """`name`, with underscores behind it until neither `df` nor `others` has it (in any letter case)."""
    known = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in known:
        name += "_"
    return name


def kept(df: DataFrame, new: list[str] | tuple[str, ...]) -> list[Column]:
    """The columns of `df` but for those whose names (in any letter case) the `new` ones take."""
    taken = {n.lower() for n in new}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def spare_prefix(df: DataFrame, prefix: str) -> str:
    """`prefix`, with underscores behind it until no column of `df` begins with it (in any letter case)."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
