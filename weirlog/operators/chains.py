"""The chain of segment starts by pointer doubling: no task follows a whole token.

A strip is a stretch of positions ``first`` to ``last`` that segments do not leave.
From a start ``base`` segments fill up every ``messages`` positions until a start
falls on a candidate, whose segment ends early: the next base is the candidate's
``aged`` position. So the chain of a strip is a linked list over its candidates,
and each candidate's successor is the next candidate at or after its ``aged``
position that lies a multiple of ``messages`` from there.

1. Successors are found for all candidates at once, in windows over blocks of
   positions of one remainder, with the first candidates of the blocks behind for
   those that their own block does not answer.
2. Jumps over 2, 4, 8... successors come from joining the jumps before with
   themselves, with the segments they pass added up.
3. Starting with the head of each strip, the longest jumps first, every round adds
   to the candidates known to be on a chain those one jump ahead of them. Each
   candidate of the chain is reached once, and with it its segment number.

The rounds are the logarithm of the longest chain, and every step is a join or a
window whose groups are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.session import Scratch

BLOCK = 1_000_000  # positions whose candidates share a window at most


def _passed(start: Column, stop: Column, messages: int) -> Column:
    """Segments that begin from ``start`` to ``stop``, both starts of segments."""
    return F.floor((stop - start) / messages) + 1


def next_candidates(probes: DataFrame, candidates: DataFrame, messages: int) -> DataFrame:
    """``probes`` (``strip``, ``at`` and more) with ``hit``: the next candidate of the strip in step with ``at``.

    ``candidates`` has ``strip`` and ``pos``.
    """
    names = probes.columns
    step = lambda df, at: df.withColumn("_rest", F.pmod(at, F.lit(messages))).withColumn("_block", F.floor(at / BLOCK))
    both = step(probes, F.col("at")).unionByName(
        step(candidates.select("strip", F.col("pos").alias("at"), F.col("pos").alias("_pos")), F.col("at")),
        allowMissingColumns=True,
    )
    group = ["strip", "_rest", "_block"]
    # Descending, and a candidate before the probes of its own position.
    behind = (
        Window.partitionBy(*group)
        .orderBy(F.desc("at"), F.col("_pos").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("hit", F.last("_pos", ignorenulls=True).over(behind)).where("_pos is null")
    heads = both.groupBy(*group).agg(F.min("_pos").alias("_head"))
    later = Window.partitionBy("strip", "_rest").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_later", F.last("_head", ignorenulls=True).over(later)).drop("_head")
    return found.join(heads, group).select(*names, F.coalesce("hit", "_later").alias("hit"))


def _jumps(first: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Jumps over 1, 2, 4... successors: ``strip``, ``pos``, ``to`` and ``passed``; only those that exist."""
    levels = [first]
    while True:
        near = levels[-1]
        far = near.select("strip", F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("passed").alias("_passed"))
        twice = near.join(far, ["strip", "to"]).select(
            "strip", "pos", F.col("_to").alias("to"), (F.col("passed") + F.col("_passed")).alias("passed")
        )
        twice = scratch.table(twice, "jumps")
        if twice.isEmpty():
            return levels
        levels.append(twice)


def runs(strips: DataFrame, candidates: DataFrame, messages: int, scratch: Scratch) -> DataFrame:
    """Stretches of positions with their segment's arithmetic: ``strip``, ``start``, ``last``, ``base``, ``number``.

    ``strips`` has ``strip`` (an id), ``first``, ``last`` and ``base``, the start of
    the segment that holds the first row. ``candidates`` has ``strip``, ``pos`` and
    ``aged``. A row at position p of a run is in segment ``number + (p - base) DIV
    messages``, counted from 0 in the strip.
    """
    ends = strips.select("strip", "last")
    candidates = candidates.join(ends, "strip").where("aged <= last")
    candidates = scratch.table(candidates, "chain-candidates")
    probes = candidates.select("strip", F.col("aged").alias("at"), "pos", "last")
    heads = strips.select("strip", F.col("base").alias("at"), F.lit(None).cast("bigint").alias("pos"), "last")
    linked = next_candidates(probes.unionByName(heads), candidates, messages)
    then = candidates.select("strip", F.col("pos").alias("hit"), F.col("aged").alias("_next"))
    # ``at`` is the base behind a candidate (or of the strip), ``_next`` the base after that.
    linked = scratch.table(linked.join(then, ["strip", "hit"], "left"), "links")
    passed = _passed(F.col("at"), F.col("hit"), messages).alias("passed")
    first = linked.where("pos is not null and hit is not null").select("strip", "pos", F.col("hit").alias("to"), passed)
    reached = linked.where("pos is null and hit is not null").select("strip", F.col("hit").alias("pos"), passed)
    for level in reversed(_jumps(first, scratch)):
        ahead = level.withColumnRenamed("passed", "_more")
        ahead = reached.join(ahead, ["strip", "pos"]).select(
            "strip", F.col("to").alias("pos"), (F.col("passed") + F.col("_more")).alias("passed")
        )
        reached = scratch.table(reached.unionByName(ahead), "reached")
    opening = linked.where("pos is null").withColumn("number", F.lit(0).cast("bigint"))
    going_on = linked.join(reached, ["strip", "pos"]).withColumnRenamed("passed", "number")
    every = opening.unionByName(going_on.select(*opening.columns)).join(strips.select("strip", "first"), "strip")
    every = every.select(
        "strip",
        F.greatest("at", "first").alias("start"),
        F.coalesce(F.col("_next") - 1, F.col("last")).alias("last"),
        F.col("at").alias("base"),
        "number",
    )
    return every.where("start <= last")
