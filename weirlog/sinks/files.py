"""Console, segment files, archive, and several sinks at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.operators.render import frame, with_json
from weirlog.operators.segments import segment_key, segment_names
from weirlog.session import Scratch, remove_listed, shuffles_removed

_REMOVERS = 8  # folders removed at a time
# Segments are archived in turns of so many bytes, and in so many turns at most.
_TURN_BYTES = 256 << 20
_TURNS = 16

# Codec names of the options and what the text writer calls them.
CODECS = {"none": "none", "gz": "gzip", "bz2": "bzip2", "lz4": "lz4"}


def writer_options(codec: str = "none", level: int = schemas.DEFAULT_COMPRESSION_LEVEL) -> dict[str, str]:
    """Options of the text writer for a codec and a level from 1 to 9 (gz only)."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {sorted(CODECS)}, not {codec!r}")
    if not 1 <= level <= 9:
        raise ValueError("level must be from 1 to 9")
    options = {"compression": CODECS[codec]}
    if codec == "gz":
        # The writer's names of the nine levels.
        names = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")
        options["zlib.compress.level"] = names[level - 1]
    return options


def console_text(df: DataFrame, pretty: bool = True, framing: str = "blank-lines") -> DataFrame:
    """What the console prints for each message, as column ``value`` beside ``sequence``, in order."""
    rows = df.orderBy("sequence") if "sequence" in df.columns else df.withColumn("sequence", F.lit(None).cast("bigint"))
    return with_json(rows, pretty).select("sequence", frame(F.col("json"), framing).alias("value"))


def write_console(df: DataFrame, pretty: bool = True, framing: str = "blank-lines"):
    """A debugging sink: every message, framed, on standard output in order.

    Rows come to the driver one partition at a time. A stream returns the
    unstarted writer.
    """

    def show(rows: DataFrame, batch_id: int | None = None) -> None:
        for row in console_text(rows, pretty, framing).select("value").toLocalIterator():
            print(row.value)

    return df.writeStream.foreachBatch(show) if df.isStreaming else show(df)


def write_segments(
    df: DataFrame,
    store: str,
    prefix: str = "",
    suffix: str = schemas.DEFAULT_SUFFIX,
    layout: str = schemas.DEFAULT_ARCHIVE_LAYOUT,
    keys: Sequence[str] = (),
    pretty: bool = False,
    framing: str = "sequence",
    codec: str = "none",
    level: int = schemas.DEFAULT_COMPRESSION_LEVEL,
    mode: str = "error",
    archived_names: bool = True,
    batch: int | None = None,
) -> None:
    """Write one file per segment below ``store/month=.../segment_name=...``.

    Needs ``token``, ``segment`` and the message columns; ``started_at`` is taken
    as given or found. One shuffle by segment serves the start, the order and the
    write. A segment has at most the row limit it was cut with, so one task writes
    it whole and in order, spilling where it must.

    With ``batch``, the files go one folder deeper and replace what an earlier run
    of the same batch has written there.
    """
    segment_columns = [*keys, "token", "segment"]
    df = df.repartition(*segment_columns)
    if "started_at" not in df.columns:
        df = df.withColumn("started_at", F.min("timestamp").over(Window.partitionBy(*segment_columns)))
    current, month, archived = segment_names(
        F.col("token"), F.col("started_at"), segment_key(keys), prefix, suffix, layout
    )
    folders = ["month", "segment_name"]
    df = with_json(df, pretty).select(
        month.alias("month"),
        (archived if archived_names else current).alias("segment_name"),
        "sequence",
        frame(F.col("json"), framing).alias("value"),
    )
    # A folder that is the same for all rows would drop out of the sort as a constant; the
    # writer would then sort by the folders again, and the order of the messages be lost.
    nothing = F.substring("value", 1, 0)
    df = df.withColumns({name: F.concat(name, nothing) for name in folders})
    if batch is not None:
        df = df.withColumn("batch", F.length(nothing) + batch)
        folders.append("batch")
    writer = df.sortWithinPartitions(*folders, "sequence").drop("sequence").write
    if batch is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
        mode = "overwrite"
    with shuffles_removed(df.sparkSession):
        writer.mode(mode).options(**writer_options(codec, level)).partitionBy(*folders).text(store)


def archive(
    spark: SparkSession,
    current_store: str,
    archive_store: str | None = None,
    codec: str = "none",
    level: int = schemas.DEFAULT_COMPRESSION_LEVEL,
    closed: DataFrame | None = None,
    remove: bool = True,
) -> int:
    """Rewrite segments of the current store compressed; returns how many.

    ``closed`` (column ``segment_name``) names the segments to move, by default
    all; its column ``archived_name``, if there, gives them other names. Messages
    keep their order, also over the batches of a stream, each of which keeps
    a file of its own. Segments take turns: the originals of a turn are removed only
    after their compressed copies are committed, and before the next turn, so that
    at most a part of the store is there twice. A run that is repeated after a failure
    replaces the copies it made before. The archive must be another folder than the store.
    """
    target = archive_store or f"{current_store.rstrip('/')}-archived"
    if target.rstrip("/") == current_store.rstrip("/"):
        raise ValueError("the archive must be another folder than the current store")
    read = spark.read.option("lineSep", "\n")
    # A store written by a stream has a folder for each batch of a segment.
    batches = ["batch"] if "batch" in read.text(current_store).columns else []
    placed = "month string, segment_name string" + "".join(f", {b} bigint" for b in batches)
    folders = ["month", "segment_name", *batches]
    name = F.col("segment_name")
    names, renamed = None, False
    if closed is not None:
        names = closed.withColumnRenamed("segment_name", "_closed")
        renamed = "archived_name" in closed.columns
        names = names.select("_closed", *(["archived_name"] if renamed else [])).distinct()
        name = F.coalesce("archived_name", name) if renamed else name

    def to_move(rows: DataFrame) -> DataFrame:
        rows = rows if names is None else rows.join(names, F.col("segment_name") == F.col("_closed"))
        return rows.withColumn("_name", name)

    with Scratch(spark) as scratch:
        # Files with their folders and sizes, noted before anything is moved; no content is read.
        files = spark.read.format("binaryFile").schema(f"{_FILE}, {placed}").load(current_store)
        path = F.col("_metadata.file_path")
        files = to_move(files.where("length > 0").select(*folders, path.alias("_file"), "length"))
        folder = F.regexp_extract("_file", "^(.*)/[^/]*$", 1)
        files = files.select("month", "segment_name", "_name", "length", "_file", folder.alias("folder"))
        moved = scratch.table(files, "moved")
        turns = _turns(moved, renamed)
        # The month and the current name are in the paths: a turn lists and reads its own files only.
        turn = F.pmod(F.xxhash64("month", "segment_name"), F.lit(turns))
        stored = read.schema(f"value string, {placed}").text(current_store)
        for at in range(turns):
            lines = stored.where(turn == at).select(
                *folders,
                "value",
                path.alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row"),
            )
            with shuffles_removed(spark):
                (
                    to_move(lines)
                    .repartition(*folders)
                    .sortWithinPartitions(*folders, "_file", "_block", "_row")
                    .select("month", F.col("_name").alias("segment_name"), *batches, "value")
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .options(**writer_options(codec, level))
                    .partitionBy(*folders)
                    .text(target)
                )
            if remove:
                with ThreadPoolExecutor(_REMOVERS) as pool:
                    rows = (row.folder for row in moved.where(turn == at).select("folder").distinct().toLocalIterator())
                    for _ in pool.map(lambda path: remove_listed(spark, path), rows):
                        pass
        return moved.select("segment_name").distinct().count()


# Fixed value: the columns that the reader of whole files has.
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _turns(moved: DataFrame, renamed: bool) -> int:
    """In how many turns files are moved: one for few bytes, and where segments get one name between them."""
    size = moved.select("_file", "length").distinct().agg(F.sum("length")).first()[0] or 0
    turns = max(1, min(_TURNS, -(-size // _TURN_BYTES)))
    if renamed and turns > 1:
        shared = moved.groupBy("month", "_name").agg(F.count_distinct("segment_name").alias("n"))
        if not shared.where("n > 1").isEmpty():
            return 1
    return turns


Sink = Callable[[DataFrame], None]


def fan_out(df: DataFrame, *sinks: Sink) -> None:
    """Give every message to every sink, in order.

    The batch is computed once and kept on disk where memory runs short; a lost
    executor's part is computed again.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()
