"""Reading written segments back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.operators.render import READ_SCHEMA, RECORD_SEPARATOR, messages_from_read

FOLDERS = (T.StructField("month", T.StringType()), T.StructField("segment_name", T.StringType()))
_SEPARATORS = {"sequence": RECORD_SEPARATOR, "blank-lines": "\n\n"}


def _read(spark: SparkSession, path: str, framing: str) -> DataFrame:
    broken = T.StructField("_broken", T.StringType())
    rows = (
        spark.read.schema(T.StructType([*READ_SCHEMA, broken, *FOLDERS]))
        .option("lineSep", _SEPARATORS[framing])
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    # Blank stretches between separators are not records.
    blank = F.btrim("_broken", F.lit(" \t\r\n\x1e")) == ""
    return rows.where(F.col("schema").isNotNull() | (F.col("_broken").isNotNull() & ~blank))


def scan_archive(
    spark: SparkSession, path: str | list[str], framing: str = "sequence", unreadable: str = "fail"
) -> DataFrame:
    """Messages from plain or compressed segment files, with ``month`` and ``segment_name``.

    The two come from the folder names and prune the files a filter on them needs;
    they are NULL for files outside such folders. ``path`` may be folders of
    single months, so that no others are listed. A record that cannot be read, such as
    one cut short, fails the scan; with ``unreadable="skip"`` it is left to
    :func:`scan_unreadable`.
    """
    if unreadable not in ("fail", "skip"):
        raise ValueError(f"unreadable must be 'fail' or 'skip', not {unreadable!r}")
    rows = _read(spark, path, framing)
    good = F.col("_broken").isNull()
    if unreadable == "fail":
        what = F.concat(F.lit("unreadable record: "), F.substring("_broken", 1, 200))
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
    return messages_from_read(rows.where(good), keep=("month", "segment_name"))


def scan_unreadable(spark: SparkSession, path: str | list[str], framing: str = "sequence") -> DataFrame:
    """The records that :func:`scan_archive` cannot read: ``month``, ``segment_name``, ``record``."""
    rows = _read(spark, path, framing).where(F.col("_broken").isNotNull())
    return rows.select("month", "segment_name", F.col("_broken").alias("record"))
