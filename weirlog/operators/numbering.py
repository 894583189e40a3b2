"""Gap-free positions over a total order, without one task seeing all rows.

A window without a partition key moves everything into one task, and one per
day fails on the day (or the instant) that holds a third of the rows. So the
order itself is cut into splits of about equal row counts:

1. the rows are written down as they come, so that what is before, the decoding of raw
   input say, is computed once. Their count is then in the files, and a sample of the
   order columns at the rate that gives some keys per split, however many tasks read
   them, has the bounds of the splits;
2. a row finds its split by binary search over the bounds;
3. with :func:`with_sequence` the rows move to their splits once, are sorted there and
   written. A number is the rows of the splits before, one aggregate over a
   column that is the same all along a split, plus the row's place in its file. So
   reading the table again, after a lost executor or for another query, gives the
   same numbers without sorting anything.

Where rows are not written (:func:`with_positions`), their place comes from
``row_number`` inside the split. A row's split depends on its own key only, so a
recomputed task gives the same positions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.session import Scratch, new_folder, shuffles_removed

# Splits per shuffle partition: several small ones even out what hashing puts
# into one task.
_SPLITS_PER_PARTITION = 2
# More splits are made where they would hold more rows than this.
_ROWS_PER_SPLIT = 2_000_000
_SAMPLED = 24  # sampled keys for each split, on the average
# So many bounds are part of the plan; more are a table of one row.
_PLANNED_BOUNDS = 2_000


def order_key(df: DataFrame, name: str) -> Column:
    """An order column as a value that survives the trip through a JSON literal."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    if isinstance(kind, T.StringType):
        return column
    raise TypeError(f"cannot order by {name}: {kind.simpleString()}")


class Splits(NamedTuple):
    key_type: str
    bounds: list[tuple]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def _texts(self) -> tuple[str, str]:
        names = [f"k{i}" for i in range(len(self.bounds[0]))] if self.bounds else []
        return json.dumps([dict(zip(names, bound)) for bound in self.bounds]), json.dumps(self.before())

    def find(self, key: Column) -> Column:
        """Number (from 0) of the split that ``key`` falls into."""
        bounds = F.from_json(F.lit(self._texts()[0]), f"array<{self.key_type}>")
        return last_at_or_below(bounds, F.lit(len(self.bounds)), key, len(self.bounds))

    def with_split(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """:meth:`find` as a column; bounds that are too many for a plan come from a broadcast row."""
        if len(self.bounds) <= _PLANNED_BOUNDS:
            return df.withColumn(out, self.find(key))
        # Some 50 bytes per split, and a split holds millions of rows where there are so many.
        folder = new_folder(df.sparkSession, "bounds")
        table = df.sparkSession.createDataFrame([tuple(b) for b in self.bounds], self.key_type)
        table.select(F.struct(*table.columns).alias("k")).write.parquet(folder)
        rows = df.sparkSession.read.parquet(folder).agg(F.array_sort(F.collect_list("k")).alias("_bounds"))
        found = last_at_or_below(F.col("_bounds"), F.lit(len(self.bounds)), key, len(self.bounds))
        return df.crossJoin(F.broadcast(rows)).withColumn(out, found).drop("_bounds")

    def find_position(self, position: Column) -> Column:
        """Number (from 0) of the split that holds a position (from 1)."""
        firsts = [before + 1 for before in self.before()]
        bounds = F.from_json(F.lit(json.dumps(firsts)), "array<bigint>")
        return last_at_or_below(bounds, F.lit(len(firsts)), position, len(firsts))

    def before(self) -> list[int]:
        return [0, *accumulate(self.counts)][: len(self.counts)]

    def rows_before(self, split: Column) -> Column:
        return F.get(F.from_json(F.lit(self._texts()[1]), "array<bigint>"), split)


def last_at_or_below(bounds: Column, n: Column, key: Column, at_most: int) -> Column:
    """Binary search: index of the last of ``n`` sorted bounds that is <= key, at least 0.

    ``at_most`` limits ``n``. Interpreted, but only about log2(at_most)
    comparisons per row.
    """
    steps = [1 << k for k in range(max(at_most, 1).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= n) & (F.get(bounds, low + step - 1) <= key), low + step
        ).otherwise(low),
    )
    return F.greatest(found - 1, F.lit(0))


def key_struct(columns: Sequence[Column]) -> Column:
    return F.struct(*[column.alias(f"k{i}") for i, column in enumerate(columns)])


def _keys(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.select(*[order_key(df, name).alias(f"k{i}") for i, name in enumerate(order)])


def cut_splits(df: DataFrame, order: Sequence[str], splits: int | None = None) -> Splits:
    """Bounds that cut the order into splits of about equal size, not counted yet.

    Reads the order columns only, twice: the rows are counted, then sampled at
    a rate that brings some keys per split to the driver, whatever the number
    of tasks.
    """
    if splits is None:
        splits = _SPLITS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(df, order)
    key_type = keys.select(F.struct(*keys.columns).alias("k")).schema["k"].dataType.simpleString()
    total = keys.count()
    splits = max(splits, -(-total // _ROWS_PER_SPLIT))
    if total > _SAMPLED * splits:
        keys = keys.where(F.rand(17) < _SAMPLED * splits / total)
    sample = sorted(map(tuple, keys.collect())) if total else []
    bounds = sorted({sample[len(sample) * i // splits] for i in range(splits)}) if sample else []
    if total and not bounds:  # nothing was drawn: all rows are one split
        bounds = [tuple(keys.limit(1).first() or _keys(df, order).first())]
    return Splits(key_type, bounds, [])


def measure_splits(df: DataFrame, order: Sequence[str], splits: int | None = None) -> Splits:
    """Cut the order into splits of about equal size and count each exactly.

    Reads the order columns only. The collected result has one row per split.
    """
    found = cut_splits(df, order, splits)
    if not found.bounds:
        return found
    keys = _keys(df, order)
    parts = found.with_split(keys, key_struct([F.col(c) for c in keys.columns]), "part")
    counts = {row["part"]: row["count"] for row in parts.groupBy("part").count().collect()}
    return found._replace(counts=[counts.get(i, 0) for i in range(len(found.bounds))])


def measure_positions(
    df: DataFrame, order: Sequence[str], position: str, splits: int | None = None
) -> Splits:
    """Splits of rows that carry gap-free positions from 1 along ``order`` already.

    Two aggregates without a shuffle of rows; ``_split`` of a row is
    ``(position - 1) DIV size``, which :func:`positions_split` gives.
    """
    if splits is None:
        splits = _SPLITS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.max(position)).first()[0] or 0
    size = max(1, -(-total // splits))
    keys = df.select(
        *[order_key(df, name).alias(f"k{i}") for i, name in enumerate(order)],
        positions_split(F.col(position), size).alias("part"),
        F.col(position).cast("decimal(19,0)").alias("position"),
    )
    names = [f"k{i}" for i in range(len(order))]
    rows = (
        keys.groupBy("part")
        .agg(
            F.min(F.struct(*names)).alias("lowest"),
            F.count("*").alias("rows"),
            F.min("position").alias("first"),
            F.max("position").alias("last"),
            F.sum("position").alias("sum"),
            F.sum(F.col("position") * F.col("position")).alias("squares"),
        )
        .orderBy("part")
        .collect()
    )
    # Count, sum and sum of squares of a split are those of its positions 1, 2, 3...
    at = 1
    for row in rows:
        places = range(at, at + row.rows)
        expected = (places[0], places[-1], sum(places), _squares(places[-1]) - _squares(at - 1))
        if (row.first, row.last, row.sum, row.squares) != expected:
            raise ValueError(f"{position} is not gap-free from 1")
        at += row.rows
    return Splits(
        keys.select(F.struct(*names).alias("k")).schema["k"].dataType.simpleString(),
        [tuple(row.lowest) for row in rows],
        [row.rows for row in rows],
    )


def _squares(n: int) -> int:
    return n * (n + 1) * (2 * n + 1) // 6


def positions_split(position: Column, size: int) -> Column:
    return F.floor((position - 1) / size).cast("int")


def with_positions(
    df: DataFrame,
    order: Sequence[str],
    splits: Splits,
    out: str = "position",
    split: str = "_split",
    start: int = 1,
) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... along ``order``; keeps the split."""
    df = splits.with_split(df, key_struct([order_key(df, name) for name in order]), split)
    inside = Window.partitionBy(split).orderBy(*order)
    return df.withColumn(
        out, F.row_number().over(inside).cast("bigint") + splits.rows_before(F.col(split)) + (start - 1)
    )


def write_in_order(
    df: DataFrame, order: Sequence[str], splits: int | None = None, scratch: Scratch | None = None
) -> tuple[DataFrame, int]:
    """The rows in a table of the shared folder, sorted along ``order``, with ``_place`` from 0; and how many.

    Every split lies in one file without a gap, so a row's place is known from
    its row number in the file. All columns are written: select those that
    are wanted first. The table goes with ``scratch``, and stays without one.
    """
    spark = df.sparkSession
    with Scratch(spark) as unordered:
        return _write_in_order(unordered.table(df, "unordered"), order, splits, scratch)


def _write_in_order(
    df: DataFrame, order: Sequence[str], splits: int | None, scratch: Scratch | None
) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    found = cut_splits(df, order, splits)
    moved = found.with_split(df, key_struct([order_key(df, name) for name in order]), "_split")
    parts = max(1, min(len(found.bounds), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    folder = new_folder(spark, "ordered") if scratch is None else scratch.folder("ordered")
    # Neighbouring splits share a task, and no task has more than its share of them.
    share = F.floor(F.col("_split") * parts / max(1, len(found.bounds))).cast("int")
    moved = moved.repartitionById(parts, share)
    with shuffles_removed(spark):
        moved.sortWithinPartitions("_split", *order).write.parquet(folder)
    rows = spark.read.schema(moved.schema).parquet(folder)
    measured = rows.groupBy("_split").agg(F.count("*").alias("n"), F.min(F.col("_metadata.row_index")).alias("first"))
    begins, at = [], 0
    for row in measured.orderBy("_split").collect():
        begins.append((row["_split"], at - row["first"]))
        at += row["n"]
    # One row per split.
    table = spark.createDataFrame(begins, "_split int, _begins bigint")
    rows = rows.withColumn("_row", F.col("_metadata.row_index")).join(F.broadcast(table), "_split")
    return rows.withColumn("_place", F.col("_row") + F.col("_begins")).select(*df.columns, "_place"), at


def with_sequence(
    df: DataFrame,
    order: Sequence[str] = ("received_at", "collector_type", "record_id"),
    start: int = 1,
    splits: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``sequence``: 1, 2, 3... in arrival order over all rows, which are written down sorted.

    ``order`` should tell rows apart. Rows equal in all of it are numbered within
    one task, so where copies may be many, add :func:`with_arrival_id` first. What is
    written goes with ``scratch``, if given.
    """
    rows, _ = write_in_order(df, order, splits, scratch)
    return rows.withColumn("sequence", F.col("_place") + start).drop("_place")


def with_arrival_id(df: DataFrame, out: str = "record_id") -> DataFrame:
    """A unique id per row in reading order, written down once.

    The ids depend on how the input was cut into tasks, so they are not computed
    again. The table in the shared folder is columnar: a pass over the order
    columns reads no others.
    """
    numbered = df.withColumn(out, F.monotonically_increasing_id())
    folder = new_folder(df.sparkSession, "arrivals")
    numbered.write.parquet(folder)
    return df.sparkSession.read.schema(numbered.schema).parquet(folder)


def prefix_sums(
    df: DataFrame, position: str, values: dict[str, str], block: int = 100_000
) -> DataFrame:
    """Running totals along a gap-free integer ``position``, in two levels.

    Totals are taken inside blocks of positions and then over the blocks, which
    are ``block`` times fewer, so the only unpartitioned window is over those.
    """
    df = df.withColumn("_block", F.floor(F.col(position) / block))
    inside = Window.partitionBy("_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({out: F.sum(name).over(inside) for name, out in values.items()})
    blocks = df.groupBy("_block").agg(*[F.sum(name).alias(f"_sum_{out}") for name, out in values.items()])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_block",
        *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in values.values()],
    )
    # No hint: the planner broadcasts the blocks if their measured size allows it.
    df = df.join(blocks, "_block")
    df = df.withColumns({out: F.col(out) + F.col(f"_before_{out}") for out in values.values()})
    return df.drop("_block", *[f"_before_{out}" for out in values.values()])
