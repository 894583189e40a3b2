"""Carrying whole input rows beside an operator's own columns, whatever those are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, **own: Column) -> DataFrame:
    """The input row as one column ``row`` beside an operator's own columns."""
    whole = F.struct(*[quoted(c).alias(c) for c in df.columns]) if df.columns else F.struct()
    return df.select(whole.alias("row"), *[column.alias(name) for name, column in own.items()])


def unpack(df: DataFrame, columns: list[str], **computed: Column) -> DataFrame:
    """The input's columns again, with computed ones in place of or behind them.

    A computed column takes the place of an input column of the same name.
    """
    new = {name.lower(): column.alias(name) for name, column in computed.items()}
    kept = [
        new.pop(c.lower()) if c.lower() in new else F.col("row").getField(c).alias(c) for c in columns
    ]
    return df.select(*kept, *new.values())
