"""Reading landed syslog frames and HTTP requests, in batch or as a stream."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.operators.syslog import check_format


def throttle(
    max_files: int | None = None, max_bytes: str | None = None, max_offsets: int | None = None
) -> dict[str, str]:
    """Stream source options that bound what one micro-batch takes in.

    ``max_offsets`` is for message queues, the other two for files.
    """
    options = {
        "maxFilesPerTrigger": max_files,
        "maxBytesPerTrigger": max_bytes,
        "maxOffsetsPerTrigger": max_offsets,
    }
    return {name: str(value) for name, value in options.items() if value is not None}


def _receipt(streaming: bool, received_at: datetime | None) -> Column:
    if received_at is None and streaming:
        # Fixed per micro-batch, and the same again if the batch is replayed.
        return F.current_timestamp()
    # `current_timestamp()` would change from job to job of one batch run.
    instant = received_at or datetime.now(timezone.utc)
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round(instant.timestamp() * 1_000_000)))


def scan_syslog(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    identifier: str | None = None,
    format: str = "rfc3164",
    received_at: datetime | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Frames from text files, one per line.

    Columns ``message_raw``, ``received_at``, ``collector_identifier``. Lines end with a
    line feed; one carriage return before it is not part of the frame, others
    are. ``format`` is checked here so that a wrong one fails before anything is read.
    """
    check_format(format)
    reader = spark.readStream if streaming else spark.read
    lines = reader.option("lineSep", "\n").options(**(options or {})).text(path)
    returned = F.endswith("value", F.lit("\r"))
    bare = F.when(returned, F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    lines = lines.withColumn("value", bare)
    return frames_from_column(lines, "value", streaming, identifier, received_at)


def frames_from_column(
    df: DataFrame,
    column: str = "value",
    streaming: bool = False,
    identifier: str | None = None,
    received_at: datetime | None = None,
) -> DataFrame:
    """Frames from a text or binary column of any source, such as a message queue."""
    receipt = F.col("received_at") if "received_at" in df.columns else _receipt(streaming, received_at)
    others = [c for c in df.columns if c not in (column, "received_at")]
    return df.select(
        *others,
        F.col(column).cast("binary").alias("message_raw"),
        receipt.alias("received_at"),
        F.lit(identifier).cast("string").alias("collector_identifier"),
    )


def scan_http(
    spark: SparkSession,
    path: str,
    *,
    streaming: bool = False,
    identifier: str | None = None,
    received_at: datetime | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Landed requests from parquet files with the columns of ``HTTP_REQUEST``.

    A request without ``received_at`` gets the instant of the run, or of the
    micro-batch.
    """
    reader = spark.readStream if streaming else spark.read
    requests = reader.schema(schemas.HTTP_REQUEST).options(**(options or {})).parquet(path)
    return requests.withColumns(
        {
            "received_at": F.coalesce("received_at", _receipt(streaming, received_at)),
            "collector_identifier": F.lit(identifier).cast("string"),
        }
    )
