"""Checking stored messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_digests(df: DataFrame) -> DataFrame:
    """Per collector: messages, messages without raw bytes, digests that do not match.

    A message without a digest is not counted as a mismatch.
    """
    expected = F.sha2(F.coalesce("message_raw", F.lit(b"")), 256)
    return df.groupBy("collector_type").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("message_raw").isNull()).alias("without_raw"),
        F.count_if(F.col("message_sha256") != expected).alias("mismatches"),
    )
