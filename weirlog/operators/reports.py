"""Counters and throughput reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.operators.numbering import prefix_sums

# Fixed value: keeps a rate finite when no time has passed.
_TINY_SECONDS = 1e-10


def _dropped(df: DataFrame):
    return F.col("dropped") if "dropped" in df.columns else F.lit(False)


def totals(df: DataFrame) -> DataFrame:
    """``processed`` and ``dropped``, one row."""
    return df.agg(F.count("*").alias("processed"), F.count_if(_dropped(df)).alias("dropped"))


def count_partials(df: DataFrame, every: int = schemas.DEFAULT_REPORT_MESSAGES, at: str = "received_at") -> DataFrame:
    """What a table or a batch adds to each report of ``every`` messages. Needs ``sequence``."""
    report = F.expr(f"(sequence - 1) DIV {int(every)}")
    return df.groupBy(report.alias("report")).agg(
        F.count("*").alias("messages"),
        F.min("sequence").alias("first_sequence"),
        F.min_by(at, "sequence").alias("first_at"),
        F.max("sequence").alias("last_sequence"),
        F.max_by(at, "sequence").alias("last_at"),
        F.count_if(_dropped(df)).alias("dropped"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial reports of several batches as one for each report."""
    return partials.groupBy("report").agg(
        F.sum("messages").alias("messages"),
        F.min("first_sequence").alias("first_sequence"),
        F.min_by("first_at", "first_sequence").alias("first_at"),
        F.max("last_sequence").alias("last_sequence"),
        F.max_by("last_at", "last_sequence").alias("last_at"),
        F.sum("dropped").alias("dropped"),
    )


def count_reports(partials: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The reports that merged partials make.

    ``before`` (one row: ``last_at``, ``processed`` and ``dropped``) is what came
    before the first of them.
    """
    # A report goes to the next one as "the report before": no self-join, and the
    # reports, which grow with the data, need no window over all of them.
    rows = ["messages", "last_at", "first_at", "dropped"]
    shared = partials.select(
        F.inline(
            F.array(
                F.struct(F.col("report"), F.lit(True).alias("own"), *rows),
                F.struct((F.col("report") + 1).alias("report"), F.lit(False).alias("own"), *rows),
            )
        )
    )
    own = lambda name: F.max(F.when(F.col("own"), F.col(name))).alias(name)
    reports = (
        shared.groupBy("report")
        .agg(*[own(name) for name in rows], F.max(F.when(~F.col("own"), F.col("last_at"))).alias("_before"))
        .where(F.col("messages").isNotNull())
    )
    reports = prefix_sums(reports, "report", {"messages": "processed", "dropped": "_all_dropped"})
    if before is not None:
        before = before.select(
            F.col("last_at").alias("_last_at"), F.col("processed").alias("_processed"), F.col("dropped").alias("_dropped")
        )
        reports = reports.crossJoin(F.broadcast(before)).withColumns(
            {
                "_before": F.coalesce("_before", "_last_at"),
                "processed": F.col("processed") + F.col("_processed"),
                "_all_dropped": F.col("_all_dropped") + F.col("_dropped"),
            }
        )
    elapsed = F.unix_micros("last_at") - F.unix_micros(F.coalesce("_before", "first_at"))
    seconds = elapsed / F.lit(1e6)
    return reports.select(
        "report",
        "messages",
        seconds.alias("seconds"),
        (F.col("messages") / (seconds + F.lit(_TINY_SECONDS))).alias("rate"),
        "processed",
        F.col("_all_dropped").alias("dropped"),
    )


def throughput_by_count(
    df: DataFrame, every: int = schemas.DEFAULT_REPORT_MESSAGES, at: str = "received_at"
) -> DataFrame:
    """A report for each ``every`` messages, and one for the rest.

    ``report`` (from 0), ``messages``, ``seconds`` since the report before,
    ``rate``, and running ``processed`` and ``dropped``. Needs ``sequence``.
    """
    return count_reports(count_partials(df, every, at))


def throughput_by_time(
    df: DataFrame,
    every: str = schemas.DEFAULT_REPORT_INTERVAL,
    at: str = "received_at",
    watermark: str | None = None,
) -> DataFrame:
    """A report for each ``every`` of time: ``start``, ``messages``, ``dropped``, ``rate``.

    With a ``watermark`` it also runs on a stream, in append mode.
    """
    if watermark is not None:
        df = df.withWatermark(at, watermark)
    reports = df.groupBy(F.window(at, every).alias("_window")).agg(
        F.count("*").alias("messages"), F.count_if(_dropped(df)).alias("dropped")
    )
    micros = F.unix_micros(F.col("_window.end")) - F.unix_micros(F.col("_window.start"))
    return reports.select(
        F.col("_window.start").alias("start"),
        "messages",
        "dropped",
        (F.col("messages") / (micros / F.lit(1e6) + F.lit(_TINY_SECONDS))).alias("rate"),
    )
