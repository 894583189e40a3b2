"""Collector messages as a stream: numbered, transformed, segmented, written.

Numbers and segments continue from batch to batch. Inside a batch they use the
same parallel operators as batch runs, so a stream in which every row has the same
calendar token is still spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weirlog import schemas
from weirlog.operators import reports
from weirlog.operators.envelope import envelope, prune_digest, prune_raw
from weirlog.operators.numbering import measure_splits, with_positions
from weirlog.operators.segments import due, open_segments, segment, segment_key, segment_names
from weirlog.operators.transform import Transformer, drop_null_replacements, enrich, replace
from weirlog.session import Scratch, folder_exists, remove_folder
from weirlog.sinks.files import archive, write_console, write_segments
from weirlog.streaming.state import BatchState

BatchSink = Callable[[DataFrame, int], None]

ARRIVAL = ("received_at", "collector_type", "record_id")


def _number_batch(
    df: DataFrame, batch_id: int, state: BatchState, order: Sequence[str]
) -> tuple[DataFrame, int]:
    """The numbered rows, and how many they are."""
    spark = df.sparkSession
    before = state.before(spark, batch_id)
    processed = before.first()["processed"] if before is not None else 0
    splits = measure_splits(df, order)
    state.save(spark.range(1).select(F.lit(processed + splits.total).alias("processed")), batch_id)
    numbered = with_positions(df, order, splits, out="sequence", start=processed + 1).drop("_split")
    return numbered, splits.total


def number_batch(
    df: DataFrame, batch_id: int, state: BatchState, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """:func:`with_sequence` for a micro-batch, going on after the batch before."""
    return _number_batch(df, batch_id, state, order)[0]


def report_batch(
    df: DataFrame, batch_id: int, state: BatchState, every: int = schemas.DEFAULT_REPORT_MESSAGES, at: str = "timestamp"
) -> DataFrame:
    """The reports of ``every`` messages that a micro-batch closes, each of them once.

    Partial reports, one small row each, are merged with the one that the batch
    before left open. What stays open is saved, with the running totals and the end of
    the last report closed, so that a replayed batch closes the same reports.
    """
    spark = df.sparkSession
    partials = reports.count_partials(df, every, at)
    before = state.before(spark, batch_id)
    closed_before = None
    if before is not None:
        open_ = before.where("report is not null").select(*partials.columns)
        partials = reports.merge_partials(partials.unionByName(open_))
        closed_before = before.select(F.col("closed_at").alias("last_at"), "processed", F.col("closed_dropped").alias("dropped"))
    partials = partials.persist(StorageLevel.MEMORY_AND_DISK)
    full = F.col("messages") == every
    found = reports.count_reports(partials.where(full), closed_before).persist(StorageLevel.MEMORY_AND_DISK)
    ended = partials.where(full).agg(F.max_by("last_at", "report").alias("closed_at"))
    sums = found.agg(F.max("processed").alias("processed"), F.max("dropped").alias("closed_dropped"))
    done = ended.crossJoin(F.broadcast(sums))
    if closed_before is not None:
        old = closed_before.select(*[F.col(c).alias(f"_{c}") for c in closed_before.columns])
        done = done.crossJoin(F.broadcast(old)).select(
            F.coalesce("closed_at", "_last_at").alias("closed_at"),
            F.coalesce("processed", "_processed").alias("processed"),
            F.coalesce("closed_dropped", "_dropped").alias("closed_dropped"),
        )
    zero = F.lit(0).cast("bigint")
    done = done.withColumns({c: F.coalesce(c, zero) for c in ("processed", "closed_dropped")})
    # One row: the totals, and the open report if there is one.
    state.save(done.join(partials.where(~full), F.lit(True), "left"), batch_id)
    partials.unpersist()
    return found


def _segment_batch(
    df: DataFrame, batch_id: int, state: BatchState, messages, timeout, layout, keys, at, tie, cut_at
) -> tuple[DataFrame, DataFrame]:
    """The rows with their segments and ``started_at``, and what the caller has to unpersist."""
    opened = state.before(df.sparkSession, batch_id)
    rows = segment(df, messages, timeout, layout, keys, at, tie, cut_at, opened).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    names = [*keys, "token"]
    firsts = rows.groupBy(*names, "segment").agg(F.min(at).alias("_first"))
    latest = open_segments(rows, keys, at)
    if opened is not None:
        earlier = opened.select(
            *names,
            F.col("segment").alias("_segment"),
            F.col("count").alias("_count"),
            F.col("started_at").alias("_started_at"),
        )
        latest = latest.join(earlier, names, "full")
        goes_on = F.equal_null("segment", F.col("_segment"))
        latest = latest.select(
            *names,
            F.coalesce("segment", "_segment").alias("segment"),
            F.when(goes_on, F.col("count") + F.col("_count")).otherwise(F.coalesce("count", "_count")).alias("count"),
            F.when(goes_on, F.col("_started_at"))
            .otherwise(F.coalesce("started_at", "_started_at"))
            .alias("started_at"),
        )
        firsts = firsts.join(earlier, names, "left").withColumn(
            "_first", F.when(goes_on, F.col("_started_at")).otherwise(F.col("_first"))
        )
    state.save(latest, batch_id)
    firsts = firsts.select(*names, "segment", F.col("_first").alias("started_at"))
    return rows.join(firsts, [*names, "segment"]), rows


def segment_batch(
    df: DataFrame,
    batch_id: int,
    state: BatchState,
    messages: int = schemas.DEFAULT_SEGMENT_MESSAGES,
    timeout: str | None = schemas.DEFAULT_SEGMENT_TIMEOUT,
    layout: str = schemas.DEFAULT_TOKEN_LAYOUT,
    keys: Sequence[str] = (),
    at: str = "timestamp",
    tie: Sequence[str] = ("sequence",),
    cut_at: Sequence[datetime] = (),
) -> DataFrame:
    """:func:`segment` for a micro-batch, going on with the segments left open.

    Adds ``started_at`` too. A row that comes after its token has passed goes on
    with that token's last segment. The rows stay cached until the caller
    unpersists what ``df.sparkSession`` holds; :func:`segment_sink` does.
    """
    return _segment_batch(df, batch_id, state, messages, timeout, layout, keys, at, tie, cut_at)[0]


_READ = ("collector_type", "collector_identifier", "message_raw", "message_sha256", "message_text", "message_json", "message_metadata")


def _as_read(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns that numbering and the envelope read, in types that a table can have."""
    names = ["received_at", *order]
    others = [F.col(n).cast(schemas.MESSAGE[n].dataType).alias(n) for n in _READ if n not in names]
    return records.select(*dict.fromkeys(names), *others)


Step = Callable[[DataFrame], DataFrame]


def stream_messages(
    records: DataFrame,
    state: str,
    sinks: Sequence[BatchSink],
    order: Sequence[str] = ARRIVAL,
    transformer: Transformer | None = None,
    replacing: bool = False,
    keep_raw: bool = True,
    keep_sha256: bool = True,
    decode: Step | None = None,
    rejects: Step | None = None,
    quarantine: BatchSink | None = None,
    report: BatchSink | None = None,
    report_every: int = schemas.DEFAULT_REPORT_MESSAGES,
) -> DataStreamWriter:
    """Number, envelope, transform and prune a stream of records, for every sink.

    Returns the writer: choose a trigger, give it a ``checkpointLocation``, start
    it. A sink gets the messages and the batch id, by which it can replace what an
    interrupted run has left.

    ``records`` may be raw frames or requests: ``decode`` makes records of them and
    ``rejects`` lists those it refuses, for ``quarantine``. Both must keep
    ``record_id``. Rows without that column get one, in reading order; the batch is
    written down with it, so that a repeated batch has the same. The counts of
    each batch and of all so far are saved below ``state``: see :func:`stream_totals`.
    Records and messages of a batch are tables there while the batch runs.
    ``report`` gets the throughput reports of ``report_every`` messages that a
    batch closes.
    """
    folder = state.rstrip("/")
    names = ("sequence", "arrivals", "totals", "reports")
    numbers, arrivals, totals, reported = (BatchState(f"{folder}/{n}") for n in names)
    work = f"{folder}/work"

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        remove_folder(spark, work)  # what a run that was ended has left
        if "record_id" not in df.columns:
            df = arrivals.once(df.withColumn("record_id", F.monotonically_increasing_id()), batch_id)
        with Scratch(spark, work) as held:
            refused = 0
            if rejects is not None:
                refused_rows = rejects(df)
                if quarantine is not None:
                    refused_rows = held.table(refused_rows, "rejects")
                    quarantine(refused_rows, batch_id)
                refused = refused_rows.count()
            messages, processed = number_and_transform(df, batch_id, held)
            replaced = transformer is not None and replacing
            kept = drop_null_replacements(messages) if replaced else messages
            kept = prune_digest(prune_raw(kept, keep_raw), keep_sha256)
            for sink in sinks:
                sink(kept, batch_id)
            if report is not None:
                closed = report_batch(messages, batch_id, reported, report_every)
                report(closed, batch_id)
                closed.unpersist()
            counts = {"processed": processed, "dropped": processed - kept.count(), "rejected": refused}
            before = totals.before(spark, batch_id)
            earlier = before.first() if before is not None else None
            so_far = {f"all_{c}": n + (earlier[f"all_{c}"] if earlier else 0) for c, n in counts.items()}
            totals.save(spark.createDataFrame([{**counts, **so_far}], _TOTALS), batch_id)

    def number_and_transform(df: DataFrame, batch_id: int, held: Scratch) -> tuple[DataFrame, int]:
        """The messages of a batch, before any is left out, and how many they are.

        Records and messages are tables, not cached rows: a batch may be far larger than
        the executors' memory, and few of its files may hold all of it.
        """
        with Scratch(df.sparkSession, work) as decoded:
            taken = _as_read(decode(df) if decode is not None else df, order)
            numbered, processed = _number_batch(decoded.table(taken, "records"), batch_id, numbers, order)
            messages = envelope(numbered)
            if transformer is not None:
                messages = (replace if replacing else enrich)(messages, transformer)
            return held.table(messages, "messages"), processed

    return records.writeStream.foreachBatch(run)


_COUNTS = ("processed", "dropped", "rejected")
_TOTALS = ", ".join(f"{c} bigint" for c in (*_COUNTS, *[f"all_{c}" for c in _COUNTS]))


def stream_totals(spark: SparkSession, state: str) -> DataFrame:
    """``processed``, ``dropped`` and ``rejected`` of a stream since its beginning, one row."""
    rows = stream_batches(spark, state)
    return rows.agg(*[F.max_by(f"all_{c}", "batch").alias(c) for c in _COUNTS])


def stream_batches(spark: SparkSession, state: str) -> DataFrame:
    """``batch``, its counts and those since the beginning (``all_...``), of the batches that Spark still keeps."""
    rows = spark.read.parquet(f"{state.rstrip('/')}/totals")
    return rows.select("batch", *_COUNTS, *[f"all_{c}" for c in _COUNTS])


def table_sink(path: str) -> BatchSink:
    """Messages as parquet, one folder per batch; a replayed batch replaces its own."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def segment_sink(
    store: str,
    state: str,
    messages: int = schemas.DEFAULT_SEGMENT_MESSAGES,
    timeout: str | None = schemas.DEFAULT_SEGMENT_TIMEOUT,
    layout: str = schemas.DEFAULT_TOKEN_LAYOUT,
    keys: Sequence[str] = (),
    cut_at: Sequence[datetime] = (),
    archive_store: str | None = None,
    archive_codec: str = "none",
    archive_level: int = schemas.DEFAULT_COMPRESSION_LEVEL,
    archive_prefix: str | None = None,
    archive_suffix: str | None = None,
    clock: Callable[[], datetime] | None = None,
    control: str | None = None,
    **naming,
) -> BatchSink:
    """Messages as segment files. A segment may get one file from each batch it spans.

    With ``archive_store``, segments are written under their current names, and
    after each batch those that are closed are moved there, compressed, under
    their archived names: all but the last of a token, and the last too once
    ``clock`` (by default the batch's latest message) finds it :func:`due`. A message
    that comes later still adds its batch's file to the archived segment.

    ``control`` is a folder of Parquet files with a column ``cut_at``: the open
    segment is closed at each of these instants, also at those that land while the
    stream runs (see :func:`ask_for_cut`). A batch sees the cuts that are there when it first
    runs; they are written down, so that a replayed batch sees the same. The
    state has a row for each token and key, and for each segment not moved yet.
    """
    folder = state.rstrip("/")
    opened, waiting, cuts = (BatchState(f"{folder}/{n}") for n in ("segments", "waiting", "cuts"))
    prefix, suffix = naming.get("prefix", ""), naming.get("suffix", schemas.DEFAULT_SUFFIX)
    names = [*keys, "token", "segment"]

    def close(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        token, started, key = F.col("token"), F.col("started_at"), segment_key(keys)
        current, _, _ = segment_names(token, started, key, prefix, suffix)
        archived = segment_names(
            token,
            started,
            key,
            prefix if archive_prefix is None else archive_prefix,
            suffix if archive_suffix is None else archive_suffix,
            naming.get("layout", schemas.DEFAULT_ARCHIVE_LAYOUT),
        )[2]
        mine = rows.select(*names, "started_at").distinct()
        mine = mine.select(*names, current.alias("segment_name"), archived.alias("archived_name"))
        before = waiting.before(spark, batch_id)
        mine = mine if before is None else mine.unionByName(before).distinct()
        if clock is not None:
            now = clock()
        else:
            latest = rows.agg(F.max(F.unix_micros("timestamp"))).first()[0]
            now = None if latest is None else datetime.fromtimestamp(latest / 1_000_000, timezone.utc)
        open_ = opened.before(spark, batch_id + 1)
        if now is not None:
            late = due(open_, now, timeout or "1000000 days", layout).select(*names)
            open_ = open_.join(late, names, "left_anti")
        left = waiting.save(mine.join(open_.select(*names), names, "left_semi"), batch_id)
        closed = mine.join(left.select("segment_name"), "segment_name", "left_anti")
        if not closed.isEmpty():
            archive(spark, store, archive_store, archive_codec, archive_level, closed)

    def cuts_of(spark: SparkSession, batch_id: int) -> list[datetime]:
        if control is None or not folder_exists(spark, control):
            asked = spark.createDataFrame([], _CUT)
        else:
            asked = spark.read.schema(_CUT).option("recursiveFileLookup", "true").parquet(control)
        # As many rows as cuts were ever asked for.
        found = cuts.once(asked.where("cut_at is not null").distinct(), batch_id)
        micros = found.select(F.unix_micros("cut_at").alias("at")).collect()
        return [*cut_at, *[datetime.fromtimestamp(r["at"] / 1_000_000, timezone.utc) for r in micros]]

    def sink(df: DataFrame, batch_id: int) -> None:
        asked = cuts_of(df.sparkSession, batch_id)
        rows, held = _segment_batch(
            df, batch_id, opened, messages, timeout, layout, keys, "timestamp", ("sequence",), asked
        )
        try:
            write_segments(
                rows, store, keys=keys, batch=batch_id, archived_names=archive_store is None, **naming
            )
            if archive_store is not None:
                close(rows, batch_id)
        finally:
            held.unpersist()

    return sink


_CUT = "cut_at timestamp"


def ask_for_cut(spark: SparkSession, control: str, at: datetime) -> None:
    """Land a cut for the streams that read the folder: the segment open at that instant is closed there."""
    micros = round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)
    row = spark.range(1).select(F.timestamp_micros(F.lit(micros)).alias("cut_at"))
    row.write.mode("append").parquet(control)


def console_sink(pretty: bool = True, framing: str = "blank-lines") -> BatchSink:
    """The messages of each batch on standard output, for debugging."""
    return lambda df, batch_id: write_console(df, pretty, framing)


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything available now and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
