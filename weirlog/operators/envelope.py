"""Joining the collectors' records and wrapping them in the common envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog import schemas


def merge_collectors(*frames: DataFrame) -> DataFrame:
    """All records of all collectors; copies stay copies."""
    if not frames:
        raise ValueError("no collector to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def envelope(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Collector messages to messages: constant schema id, receive time, its ms.

    ``sequence`` is taken over where :func:`with_sequence` has set it.
    """
    sequence = F.col("sequence") if "sequence" in df.columns else F.lit(None)
    made = {
        "schema": F.lit(schemas.MESSAGE_SCHEMA),
        "subschema": F.lit(None),
        "sequence": sequence,
        "timestamp": F.col("received_at"),
        "timestamp_unix": F.unix_millis("received_at"),
        "message_extra": F.lit(None),
    }
    columns = []
    for field in schemas.MESSAGE:
        column = made[field.name].cast(field.dataType) if field.name in made else F.col(field.name)
        columns.append(column.alias(field.name))
    return df.select(*keep, *columns)


def prune_raw(df: DataFrame, keep_raw: bool = True) -> DataFrame:
    """Blank the raw bytes of parsed messages; an unparsed one always keeps them."""
    if keep_raw:
        return df
    unparsed = F.nullif("message_text", F.lit("")).isNull() & F.col("message_json").isNull()
    return df.withColumn("message_raw", F.when(unparsed, F.col("message_raw")))


def prune_digest(df: DataFrame, keep_sha256: bool = True) -> DataFrame:
    """Blank the digest of every message."""
    if keep_sha256:
        return df
    return df.withColumn("message_sha256", F.lit(None).cast("string"))
