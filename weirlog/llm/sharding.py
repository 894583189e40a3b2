"""Shards of near-equal bytes by histogram sort (DataFrame functions only).

Rows are put in the order of a 63-bit key and the order is cut where the exact
number of bytes below a boundary is near a multiple of the shard size. The
boundaries come from histograms: one counts the bytes under each value of the
key's leading bits, the next ones count under more bits, but only in the cells
in which a boundary is still too coarse. What the driver holds is bounded by
``CELLS``, whatever the input. The rows themselves are exchanged once, by
shard and part.

The key's upper bits are a hash of the text, the lower bits one of the id. So
equal texts stand side by side, on one shard or on neighbours, and a text that
makes up a third of all rows is still cut at the right byte.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.rows import pack, quoted, unpack
from weirlog.operators.numbering import last_at_or_below
from weirlog.session import Scratch

KEY_BITS = 63
PLACE_BITS = 24
CELLS = 1 << 16  # histogram cells a round brings to the driver, at most
PART_BYTES = 64 << 20  # aimed at for a part, the piece of a shard that one task sorts
MAX_PARTS = 1024  # parts of a shard, at most
SHARD_TOLERANCE = 0.0005  # of a shard's bytes
PART_TOLERANCE = 0.1  # of a part's bytes


def row_bytes(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of a text plus a fixed overhead; a null text has none of its own."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint")


def sort_key(text: Column, doc_id: Column) -> Column:
    group = F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS + PLACE_BITS)
    place = F.shiftrightunsigned(F.xxhash64(F.lit("place"), doc_id), 64 - PLACE_BITS)
    return F.shiftleft(group, PLACE_BITS).bitwiseOR(place)


def longs(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def find_boundaries(sized: DataFrame, goals: list[tuple[int, float]]) -> list[tuple[int, int]]:
    """For each goal (bytes below, tolerance), a key and the exact number of rows below it.

    ``sized`` has the columns ``key`` and ``size``. Each round is one
    aggregate, combined before its shuffle.
    """
    found: dict[int, tuple[int, int, int]] = {}
    # Cells that still hold goals: prefix -> (bytes below, rows below, goals).
    cells = {0: (0, 0, list(range(len(goals))))} if goals else {}
    bits = KEY_BITS
    while cells:
        step = min(bits, max(1, (CELLS // len(cells)).bit_length() - 1))
        inside = sized
        if bits < KEY_BITS:
            wanted = sized.sparkSession.range(1).select(F.explode(longs(sorted(cells))).alias("cell"))
            inside = sized.join(F.broadcast(wanted), F.shiftright("key", bits) == F.col("cell"), "left_semi")
        bits -= step
        counted = (
            inside.groupBy(F.shiftright("key", bits).alias("prefix"))
            .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
            .collect()
        )
        held: dict[int, list[tuple[int, int, int]]] = {}
        for row in sorted(counted):
            held.setdefault(row["prefix"] >> step, []).append(tuple(row))
        finer: dict[int, tuple[int, int, list[int]]] = {}
        for cell, (bytes_below, rows_below, open_goals) in cells.items():
            rows = held.get(cell, [])
            starts = list(accumulate((r[1] for r in rows), initial=bytes_below))
            counts = list(accumulate((r[2] for r in rows), initial=rows_below))
            for goal in open_goals:
                target, tolerance = goals[goal]
                if not rows:
                    found[goal] = (cell << (bits + step), rows_below, 0)
                    continue
                i = min(max(bisect_right(starts, target) - 1, 0), len(rows) - 1)
                low, high = target - starts[i], starts[i + 1] - target
                if min(abs(low), abs(high)) <= tolerance or bits == 0:
                    at = rows[i][0] + (abs(high) < abs(low))
                    found[goal] = (at << bits, counts[i + (abs(high) < abs(low))], 0)
                else:
                    finer.setdefault(rows[i][0], (starts[i], counts[i], []))[2].append(goal)
        cells = finer
    return [found[goal][:2] for goal in range(len(goals))]


def shards(
    df: DataFrame, n: int, id_column: str = "doc_id", text_column: str = "text", overhead: int = 16
) -> DataFrame:
    """Every row with its ``size``, its ``shard`` from 0 to ``n`` - 1 and its ``slot`` there.

    The bytes of the shards differ by a small tolerance, or by one row or the
    rows of one key where those are larger: rows that agree in both text and
    id have one key. Slots are gapless from 0. A null text counts as the bare
    overhead, an empty one too; null ids are one id. An empty table stays
    empty. Input columns named ``size``, ``shard`` or ``slot`` are replaced.
    """
    text, doc_id = quoted(text_column), quoted(id_column)
    size = row_bytes(text, overhead)
    key = sort_key(text, doc_id)
    with Scratch(df.sparkSession) as scratch:
        sized = scratch.table(df.select(key.alias("key"), size.alias("size")), "sizes")
        total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
        parts = min(MAX_PARTS, max(1, -(-total // (n * PART_BYTES))))
        shard_bytes = total / n
        part_bytes = shard_bytes / parts
        goals = [
            (round(i * part_bytes), SHARD_TOLERANCE * shard_bytes if i % parts == 0 else PART_TOLERANCE * part_bytes)
            for i in range(1, n * parts)
        ]
        boundaries = [(0, 0), *find_boundaries(sized, goals)]
    before = [rows - boundaries[i - i % parts][1] for i, (_, rows) in enumerate(boundaries)]

    rows = pack(df, size=size, key=key, doc_id=doc_id, tie=F.xxhash64(text))
    part = last_at_or_below(longs([k for k, _ in boundaries]), F.lit(len(boundaries)), F.col("key"), len(boundaries))
    rows = rows.withColumn("part", part)
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "tie"))
    return unpack(
        rows,
        df.columns,
        size=F.col("size"),
        shard=F.floor(F.col("part") / parts).cast("int"),
        slot=(F.get(longs(before), F.col("part")) + place - 1).cast("bigint"),
    )
