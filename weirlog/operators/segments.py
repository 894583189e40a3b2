"""Cutting the message stream into segments by count, age and calendar token.

The rule is greedy: an open segment takes a message unless it already holds
``messages`` of them, is ``timeout`` old at that instant, the calendar token has
changed, or a cut was asked for. Each start depends on the one before, so no
tumbling or session window gives it. Replaying it row by row would put a whole
day, which may be a third of all rows, into one task. Here it is done in parallel:

* A run of rows with the same series (``keys``), token and cut count is a *strip*;
  strips are contiguous in arrival order, and segments never cross them.
* A segment that fills up by count starts ``messages`` positions before the next
  one. So starts form arithmetic progressions, broken only where the age limit
  comes first.
* The age limit comes first for a segment starting at row i only if row
  i + messages - 1 is ``timeout`` later, or missing. There are at most
  ``messages`` such *candidate* rows in any ``timeout``, so at most about
  ``messages * (strip span / timeout + 2)`` per strip however many rows it has.
* Following the chain of starts needs the candidates only. For a token with few of
  them that is a scan in constant memory by one task; a token with many, as a slow
  stream with a high ``messages`` has, is ranked by pointer doubling, by all tasks
  (:mod:`weirlog.operators.chains`). Both yield *runs*: stretches of rows whose
  segment number is plain arithmetic on the position.
* Runs are few. They go back to the rows by position: broadcast if their counted
  size allows it, by a shuffled join otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.operators import chains
from weirlog.operators.numbering import (
    Splits,
    key_struct,
    last_at_or_below,
    measure_positions,
    measure_splits,
    order_key,
    positions_split,
    with_positions,
)
from weirlog.session import Scratch, reliable_checkpoint

# Marks are about 40 bytes each; beyond this count they are joined by shuffle.
MAX_BROADCAST_MARKS = 500_000
# Candidates of one token that a single task follows; more are ranked by all tasks.
MAX_SCANNED = 2_000_000
# Up to so many runs per split they are looked up in a list.
_RUNS_PER_SPLIT = 64

_UNITS = "yMdHms"


def comes_back(layout: str) -> bool:
    """Whether a token of the layout can come back later, like the hour without its day.

    It cannot if the layout names the year and every larger unit down to its finest one.
    """
    letters = set(re.sub(r"'[^']*'", "", layout)) & set("GyuYQqMLwWdDeEFaBhHKkmsSnNAVvzOXx")
    return not letters or letters != set(_UNITS[: len(letters)])


def check_layout(layout: str) -> str:
    """Accept a layout only if no token can come back later."""
    if comes_back(layout):
        raise ValueError(f"layout {layout!r} must name the year and every larger unit down to its finest")
    return layout


def layout_from_reference_time(layout: str) -> str:
    """A layout written with the reference time ``2006-01-02 15:04:05`` as a Spark pattern."""
    for digits, letters in (
        ("2006", "yyyy"),
        ("01", "MM"),
        ("02", "dd"),
        ("15", "HH"),
        ("04", "mm"),
        ("05", "ss"),
    ):
        layout = layout.replace(digits, letters)
    return layout


def with_token(
    df: DataFrame, layout: str = schemas.DEFAULT_TOKEN_LAYOUT, at: str = "received_at", out: str = "token"
) -> DataFrame:
    """Add the calendar token of the processing time."""
    return df.withColumn(out, F.date_format(at, layout))


def _micros(instant: datetime) -> int:
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return round(instant.timestamp() * 1_000_000)


def _cuts_until(instant: Column, cut_at: Sequence[datetime]) -> Column:
    """How many asked-for cuts lie at or before an instant."""
    if not cut_at:
        return F.lit(0)
    cuts = F.array(*[F.timestamp_micros(F.lit(_micros(cut))) for cut in sorted(cut_at)])
    return F.size(F.filter(cuts, lambda cut: cut <= instant))


def _series(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def segment(
    df: DataFrame,
    messages: int = schemas.DEFAULT_SEGMENT_MESSAGES,
    timeout: str | None = schemas.DEFAULT_SEGMENT_TIMEOUT,
    layout: str = schemas.DEFAULT_TOKEN_LAYOUT,
    keys: Sequence[str] = (),
    at: str = "received_at",
    tie: Sequence[str] = ("record_id",),
    cut_at: Sequence[datetime] = (),
    opened: DataFrame | None = None,
    position: str | None = None,
    splits: int | None = None,
    scanned: int | None = None,
) -> DataFrame:
    """Add ``token`` and ``segment`` (0, 1, 2... within series and token).

    ``tie`` orders rows of the same instant. ``cut_at`` lists instants at which
    the open segment is closed whatever it holds. ``opened`` continues segments
    of an earlier batch; see :func:`open_segments`.

    ``position`` may name a column that already numbers the rows 1, 2, 3...
    without gaps in the order of ``at``, such as ``sequence`` where nothing was
    dropped. Then no row has to be sorted or, with few runs, even moved.

    With a layout whose tokens come back, such as the hour alone, every stretch of
    rows with the same token is cut on its own and its token's numbers go on. Such
    a layout cannot go on with ``opened`` segments, which do not say which
    stretch they are of.

    ``scanned`` (by default ``MAX_SCANNED``) is how many candidates of a token one
    task may follow; the result does not depend on it.
    """
    if messages < 1:
        raise ValueError("messages must be at least 1")
    if position is not None and keys:
        raise ValueError("positions number all rows, so they cannot be used with keys")
    if opened is not None:
        check_layout(layout)
    spark = df.sparkSession
    if position is not None:
        order = [at, position]
        measured = measure_positions(df, order, position, splits)
        size = max(measured.counts, default=1)
        number = lambda rows: rows.withColumns(
            {"_position": F.col(position), "_split": positions_split(F.col(position), size)}
        )
    else:
        order = [*keys, at, *tie]
        measured = measure_splits(df, order, splits)
        number = lambda rows: with_positions(rows, order, measured, out="_position")

    strip = ["_series", "token", "_cuts"]
    narrow = with_token(number(df.select(*order)), layout, at).withColumns(
        {"_series": _series(keys), "_cuts": _cuts_until(F.col(at), cut_at)}
    )
    if comes_back(layout):
        narrow = _with_stretches(narrow, order)
    if timeout is not None:
        narrow = _with_status(narrow, order, strip, messages, timeout, at)
    with Scratch(spark) as scratch:
        # Time and place of each row, written once and read by the steps below.
        narrow = scratch.table(narrow.drop(*[c for c in order if c not in (*keys, at)]), "positions")
        steps = _steps(narrow, scratch, measured, strip, messages, timeout, keys, at, order, cut_at, opened)
        runs = reliable_checkpoint(_runs(steps, strip, messages, scratch, MAX_SCANNED if scanned is None else scanned))
    count = runs.count()
    rows = number(df)
    few = min(_RUNS_PER_SPLIT * max(1, len(measured.counts)), MAX_BROADCAST_MARKS)
    if position is not None and count <= few:
        rows = _runs_by_search(rows, runs, measured, count)
    else:
        rows = _runs_by_scan(rows, runs, measured, count, order)
    number_in_run = F.expr(f"(_position - _run.base) DIV {messages}")
    return (
        with_token(rows, layout, at)
        .withColumn("segment", F.col("_run")["segment"] + number_in_run)
        .drop("_position", "_split", "_run")
    )


_TOKEN = ["_series", "token"]
_RUN = ["start", "last", "base", "segment"]


def _runs(steps: DataFrame, strip: list[str], messages: int, scratch: Scratch, scanned: int) -> DataFrame:
    """Runs of all tokens: scanned where that is little work, by pointer doubling elsewhere."""
    steps = scratch.table(steps.select(*strip, "kind", "a", "b"), "steps")
    long = steps.groupBy(*_TOKEN).count().where(F.col("count") > scanned).select(*_TOKEN)
    long = scratch.table(long, "long-tokens")
    few = steps
    if not long.isEmpty():
        few = steps.join(long, _TOKEN, "left_anti")
    runs = (
        few.repartition(*_TOKEN)
        .sortWithinPartitions(*strip, "kind", "a")
        .mapInPandas(_follow(messages), "start bigint, last bigint, base bigint, segment bigint")
    )
    if few is steps:
        return runs
    return runs.unionByName(_ranked(steps.join(long, _TOKEN), strip, messages, scratch))


def _ranked(steps: DataFrame, strip: list[str], messages: int, scratch: Scratch) -> DataFrame:
    """What :func:`_follow` yields, without following: see :mod:`weirlog.operators.chains`."""
    opened = steps.where("kind = 0").select(
        *_TOKEN, F.col("_cuts").alias("_opened"), F.col("a").alias("_number"), F.col("b").alias("_count")
    )
    strips = steps.where("kind = 1").join(opened, _TOKEN, "left")
    goes_on = F.coalesce(F.col("_cuts") == F.col("_opened"), F.lit(False))
    strips = strips.select(
        *strip,
        F.col("a").alias("strip"),
        F.col("a").alias("first"),
        F.col("b").alias("last"),
        (F.col("a") - F.when(goes_on, F.col("_count")).otherwise(0)).alias("base"),
        goes_on.alias("goes_on"),
        F.coalesce(F.col("_cuts") >= F.col("_opened"), F.lit(False)).alias("after"),
        "_number",
    )
    strips = scratch.table(strips, "strips")
    candidates = steps.where("kind = 2").join(strips.select(*strip, "strip"), strip)
    candidates = candidates.select("strip", F.col("a").alias("pos"), F.col("b").alias("aged"))
    found = scratch.table(chains.runs(strips, candidates, messages, scratch), "chain-runs")
    # A token's strips, one for each cut, go on counting where the one before ended.
    segments = F.col("number") + F.floor((F.col("last") - F.col("base")) / messages) + 1
    sizes = strips.join(found.groupBy("strip").agg(F.max(segments).alias("_size")), "strip", "left")
    earlier = Window.partitionBy(*_TOKEN, "after").orderBy("_cuts")
    before = F.coalesce(F.sum("_size").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_first = F.max("goes_on").over(earlier)
    begins = F.when(F.col("after"), F.col("_number") + F.when(open_first, 0).otherwise(1)).otherwise(0)
    numbers = sizes.select("strip", (before + begins).cast("bigint").alias("_begins"))
    runs = found.join(numbers, "strip").withColumn("segment", F.col("number") + F.col("_begins"))
    return runs.select(*[F.col(c).cast("bigint") for c in _RUN])


def _by_split(runs: DataFrame, measured: Splits) -> DataFrame:
    """Runs, once for each split they reach into, at their first row there."""
    part = F.explode(
        F.sequence(measured.find_position(F.col("start")), measured.find_position(F.col("last")))
    )
    return runs.withColumn("_part", part).withColumn(
        "start", F.greatest("start", measured.rows_before(F.col("_part")) + 1)
    )


def _runs_by_scan(rows: DataFrame, runs: DataFrame, measured: Splits, count: int, order: list[str]) -> DataFrame:
    """Mark the first row of each run; the rows after it, in its split, follow it."""
    marks = _by_split(runs, measured).select(
        F.col("start").alias("_position"), F.struct("base", "segment").alias("_run")
    )
    few = count + len(measured.counts) <= MAX_BROADCAST_MARKS
    rows = rows.join(F.broadcast(marks) if few else marks, "_position", "left")
    so_far = Window.partitionBy("_split").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.last("_run", ignorenulls=True).over(so_far))


def _runs_by_search(rows: DataFrame, runs: DataFrame, measured: Splits, count: int) -> DataFrame:
    """Look the run up among the few of a row's split. Nothing is shuffled."""
    lists = (
        _by_split(runs, measured)
        .groupBy(F.col("_part").alias("_split"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "base", "segment"))).alias("_runs"))
    )
    rows = rows.join(F.broadcast(lists), "_split", "left")
    starts = F.transform("_runs", lambda run: run["start"])
    found = last_at_or_below(starts, F.size("_runs"), F.col("_position"), count)
    return rows.withColumn("_run", F.get("_runs", found)).drop("_runs")


def segment_by_count(
    df: DataFrame,
    messages: int,
    layout: str = schemas.DEFAULT_TOKEN_LAYOUT,
    keys: Sequence[str] = (),
    at: str = "received_at",
    tie: Sequence[str] = ("record_id",),
    splits: int | None = None,
) -> DataFrame:
    """:func:`segment` without an age limit."""
    return segment(df, messages, None, layout, keys, at, tie, splits=splits)


def _steps(
    rows: DataFrame,
    scratch: Scratch,
    measured: Splits,
    strip: list[str],
    messages: int,
    timeout: str | None,
    keys: Sequence[str],
    at: str,
    order: list[str],
    cut_at: Sequence[datetime],
    opened: DataFrame | None,
) -> DataFrame:
    """What :func:`_follow` scans: open segments, strips and candidates."""
    strips = rows.groupBy(*strip).agg(F.min("_position").alias("a"), F.max("_position").alias("b"))
    steps = strips.withColumn("kind", F.lit(1))
    starts = None
    if opened is not None:
        opened = opened.select(
            *keys,
            _series(keys).alias("_series"),
            "token",
            _cuts_until(F.col("started_at"), cut_at).alias("_cuts"),
            "segment",
            "count",
            "started_at",
        )
        steps = steps.unionByName(
            opened.select(*strip, F.col("segment").alias("a"), F.col("count").alias("b"), F.lit(0).alias("kind"))
        )
        # The open segment acts as a start before the first row of its strip.
        starts = opened.join(strips, strip).select(
            *keys, *strip, F.col("started_at").alias(at), (F.col("a") - F.col("count")).alias("_position")
        )
    if timeout is None:
        return steps
    candidates = _candidates(rows, strip, measured, messages, timeout, at).select(*keys, *strip, at, "_position")
    if starts is not None:
        candidates = candidates.unionByName(starts)
    # Bounded by the limits, not by the rows.
    candidates = scratch.table(candidates, "candidates")
    aged = _first_row_aged(candidates, rows, measured, timeout, keys, at, order)
    aged = aged.where(F.col("_aged") < F.col("_position") + messages)
    return steps.unionByName(
        aged.select(*strip, F.col("_position").alias("a"), F.col("_aged").alias("b"), F.lit(2).alias("kind"))
    )


def _with_stretches(rows: DataFrame, order: list[str]) -> DataFrame:
    """``_cuts`` with the changes of series and token so far added, so that a stretch is a strip.

    Changes are counted inside the splits; what lies between two splits, and the
    counts of those before, come from one row per split.
    """
    inside = Window.partitionBy("_split").orderBy(*order)
    here = F.struct("_series", "token")
    rows = rows.withColumn("_changed", F.coalesce((F.lag(here).over(inside) != here).cast("bigint"), F.lit(0)))
    splits = rows.groupBy(F.col("_split").alias("_part")).agg(
        F.min_by(here, "_position").alias("_first"),
        F.max_by(here, "_position").alias("_last"),
        F.sum("_changed").alias("_changes"),
    )
    before = Window.orderBy("_part")
    new = F.coalesce((F.lag("_last").over(before) != F.col("_first")).cast("bigint"), F.lit(0))
    splits = splits.withColumn("_new", new).select(
        "_part", (F.sum(F.col("_changes") + F.col("_new")).over(before) - F.col("_changes")).alias("_before")
    )
    so_far = F.sum("_changed").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_cuts", F.col("_cuts") + so_far).drop("_changed")
    rows = rows.join(splits, rows["_split"] == splits["_part"])
    return rows.withColumn("_cuts", F.col("_cuts") + F.col("_before")).drop("_part", "_before")


def _fills_up(ahead: Column, strip: list[str], timeout: str, at: str) -> Column:
    """Whether the row ``messages - 1`` further on comes in the same strip and in time."""
    in_time = ahead[at] < F.col(at) + F.expr(f"INTERVAL {timeout}")
    for name in strip:
        in_time = in_time & (ahead[name] == F.col(name))
    return F.coalesce(in_time, F.lit(False))


def _with_status(
    rows: DataFrame, order: list[str], strip: list[str], messages: int, timeout: str, at: str
) -> DataFrame:
    """Add ``_status``: 0 no candidate, 1 candidate, 2 the row ahead is in a later split."""
    inside = Window.partitionBy("_split").orderBy(*order)
    ahead = F.lead(F.struct(*strip, at), messages - 1).over(inside)
    rows = rows.withColumn("_ahead", ahead)
    status = F.when(F.col("_ahead").isNull(), 2).when(_fills_up(F.col("_ahead"), strip, timeout, at), 0).otherwise(1)
    return rows.withColumn("_status", status).drop("_ahead")


def _candidates(
    rows: DataFrame, strip: list[str], measured: Splits, messages: int, timeout: str, at: str
) -> DataFrame:
    """Rows at which a segment would not fill up before it is too old."""
    known = rows.where(F.col("_status") == 1)
    # Within `messages` rows of the end of a split the row ahead lies in a later
    # one, among the first `messages` there.
    heads = rows.where(F.col("_position") - measured.rows_before(F.col("_split")) < messages).select(
        (F.col("_position") - (messages - 1)).alias("_position"), F.struct(*strip, at).alias("_ahead")
    )
    unknown = rows.where(F.col("_status") == 2).join(heads, "_position", "left")
    unknown = unknown.where(~_fills_up(F.col("_ahead"), strip, timeout, at)).drop("_ahead")
    return known.unionByName(unknown)


def _first_row_aged(
    candidates: DataFrame,
    rows: DataFrame,
    measured: Splits,
    timeout: str,
    keys: Sequence[str],
    at: str,
    order: list[str],
) -> DataFrame:
    """Add ``_aged``: position of the first row at least ``timeout`` after a candidate.

    Candidates are placed among the rows at the instant they age, and read the
    position of the row just before.
    """
    probes = candidates.withColumn("_limit", F.col(at) + F.expr(f"INTERVAL {timeout}"))
    # Before any row of the limit's own instant: the ties are left empty.
    probe_key = [order_key(probes, name) for name in (*keys, "_limit")]
    key = key_struct(probe_key + [F.lit(None)] * (len(order) - len(probe_key))).cast(measured.key_type)
    probes = probes.withColumn("_split", measured.find(key))
    # Only splits that receive a probe are read again; at most one row per split.
    wanted = probes.select("_split").distinct()
    near = rows.join(wanted, "_split", "left_semi").select("_split", *keys, at, "_position")
    both = near.select("_split", *keys, F.col(at).alias("_when"), F.col("_position").alias("_row")).unionByName(
        probes.select(
            "_split", *keys, F.col("_limit").alias("_when"), "_series", "token", "_cuts", "_position"
        ),
        allowMissingColumns=True,
    )
    probe_first = F.col("_row").isNotNull()
    before = (
        Window.partitionBy("_split")
        .orderBy(*keys, "_when", probe_first)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    last_before = F.last("_row", ignorenulls=True).over(before)
    return (
        both.withColumn("_aged", F.coalesce(last_before, measured.rows_before(F.col("_split"))) + 1)
        .where(F.col("_row").isNull())
        .drop("_row", "_when")
    )


def _follow(messages: int):
    """Scan over (strip, kind, a, b) in order, holding only the open strip.

    kind 0: open segment of an earlier batch, a = its number, b = its count
    kind 1: a strip, a = first position, b = last position
    kind 2: a candidate, a = its position, b = first position too old for it
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = None  # (series, token)
        opened = None  # (cuts, segment, count)
        number = 0  # next segment number of the token
        strip = None  # (first, last)
        base = 0
        out: list[tuple[int, int, int, int]] = []

        def emit(last: int) -> None:
            start = max(base, strip[0])
            if start <= last:
                out.append((start, last, base, number))

        for batch in batches:
            for series, token, cuts, kind, a, b in zip(
                batch["_series"], batch["token"], batch["_cuts"], batch["kind"], batch["a"], batch["b"]
            ):
                if kind == 2:
                    if a >= base and (a - base) % messages == 0 and b <= strip[1]:
                        emit(b - 1)
                        number += (a - base) // messages + 1
                        base = b
                    continue
                if strip is not None:
                    emit(strip[1])
                    number += (strip[1] - base) // messages + 1
                    strip = None
                if where != (series, token):
                    where, opened, number = (series, token), None, 0
                if kind == 0:
                    opened, number = (cuts, a, b), a + 1
                else:
                    strip, base = (a, b), a
                    if opened is not None and opened[0] == cuts:
                        number, base = opened[1], a - opened[2]
                    opened = None
            if out:
                yield pd.DataFrame(out, columns=["start", "last", "base", "segment"])
                out.clear()
        if strip is not None:
            emit(strip[1])
            yield pd.DataFrame(out, columns=["start", "last", "base", "segment"])

    return scan


# -- what the segments are --------------------------------------------------------


def segment_key(keys: Sequence[str] = ()) -> Column:
    """Unique part of a segment's name: the same on every run over the same data."""
    return F.substring(
        F.sha2(F.concat_ws("/", _series(keys), F.col("token"), F.col("segment").cast("string")), 256), 1, 20
    )


def segment_names(
    token: Column,
    started_at: Column,
    unique: Column,
    prefix: str = "",
    suffix: str = schemas.DEFAULT_SUFFIX,
    layout: str = schemas.DEFAULT_ARCHIVE_LAYOUT,
    month_layout: str = schemas.DEFAULT_MONTH_LAYOUT,
) -> tuple[Column, Column, Column]:
    """(current name, archive month, archived name) of a segment."""
    current = F.concat(F.lit(prefix), token, F.lit("-"), unique, F.lit(suffix))
    archived = F.concat(F.lit(prefix), F.date_format(started_at, layout), F.lit("-"), unique, F.lit(suffix))
    return current, F.date_format(started_at, month_layout), archived


def segment_manifest(
    df: DataFrame,
    messages: int = schemas.DEFAULT_SEGMENT_MESSAGES,
    timeout: str | None = schemas.DEFAULT_SEGMENT_TIMEOUT,
    keys: Sequence[str] = (),
    at: str = "received_at",
    cut_at: Sequence[datetime] = (),
    prefix: str = "",
    suffix: str = schemas.DEFAULT_SUFFIX,
) -> DataFrame:
    """One row per segment: when, how many, why it was cut, and its names.

    ``cut_reason`` is ``flush``, ``messages``, ``timeout``, ``token``, or NULL for
    a segment that is still open.
    """
    segments = df.groupBy(*keys, "token", "segment").agg(
        F.min(at).alias("started_at"), F.max(at).alias("last_at"), F.count("*").alias("count")
    )
    in_token = Window.partitionBy(*keys, "token").orderBy("segment")
    segments = segments.withColumn("next_at", F.lead("started_at").over(in_token))
    # One row per token, so the window over all tokens of a series is small.
    tokens = df.groupBy(*keys, "token").agg(F.min(at).alias("_first"))
    by_series = Window.partitionBy(*keys, F.lit(0)).orderBy("token")
    tokens = tokens.withColumn("_after", F.lead("_first").over(by_series)).drop("_first")
    tokens = tokens.withColumnsRenamed({name: f"_t_{name}" for name in (*keys, "token")})
    same = [F.equal_null(F.col(name), F.col(f"_t_{name}")) for name in (*keys, "token")]
    segments = segments.join(tokens, same, "left").drop(*[f"_t_{name}" for name in (*keys, "token")])
    changes = F.col("next_at").isNull()
    next_at = F.coalesce("next_at", "_after")
    flushed = _cuts_until(F.coalesce(next_at, F.expr("TIMESTAMP '9999-12-31'")), cut_at) > _cuts_until(
        F.col("last_at"), cut_at
    )
    reason = F.when(flushed, F.lit("flush"))
    reason = reason.when(next_at.isNotNull() & (F.col("count") >= messages), F.lit("messages"))
    if timeout is not None:
        reason = reason.when(next_at >= F.col("started_at") + F.expr(f"INTERVAL {timeout}"), F.lit("timeout"))
    reason = reason.when(next_at.isNotNull() & changes, F.lit("token"))
    current, month, archived = segment_names(
        F.col("token"), F.col("started_at"), segment_key(keys), prefix, suffix
    )
    return segments.select(
        *keys,
        "token",
        "segment",
        "started_at",
        "last_at",
        "count",
        reason.alias("cut_reason"),
        current.alias("current_name"),
        month.alias("month"),
        archived.alias("archived_name"),
    )


def open_segments(df: DataFrame, keys: Sequence[str] = (), at: str = "received_at") -> DataFrame:
    """The last segment of each series and token, as :func:`segment` takes it up again."""
    per_segment = df.groupBy(*keys, "token", "segment").agg(
        F.min(at).alias("started_at"), F.count("*").alias("count")
    )
    last = F.max_by(F.struct("segment", "count", "started_at"), "segment")
    return per_segment.groupBy(*keys, "token").agg(last.alias("_last")).select(*keys, "token", "_last.*")


def due(open_: DataFrame, now: datetime, timeout: str, layout: str = schemas.DEFAULT_TOKEN_LAYOUT) -> DataFrame:
    """Open segments that a clock tick at ``now`` would close: too old, or another token."""
    instant = F.timestamp_micros(F.lit(_micros(now)))
    too_old = instant >= F.col("started_at") + F.expr(f"INTERVAL {timeout}")
    return open_.where(too_old | (F.col("token") != F.date_format(instant, check_layout(layout))))
