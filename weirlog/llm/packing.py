"""Packing documents into bins of a fixed length by conflict-constrained best fit.

A document longer than a bin is cut into pieces; nothing is left out. Pieces are
dealt by hash to groups of about ``GROUP`` and each group is packed by itself,
longest piece first. A group's bins are kept in the order of the room that is
left in them, each with a bitmap of the sources and one of the duplicate clusters
it holds. The search starts at the first bin with enough room and goes on to its
successors until one holds neither the piece's source nor its cluster: the
tightest compatible bin. Only if there is none a bin is opened.

Hashing spreads a source or a cluster that holds a third of all rows evenly
over the groups, whose size does not grow with the input.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted
from weirlog.session import Scratch

CAPACITY = 2048
GROUP = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cluster_of(text: Column) -> Column:
    """Equal texts, but for case and blanks, are one duplicate cluster."""
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the order given. A negative source or cluster never conflicts."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(room, (length, -1))
        while at < len(room):
            number = room[at][1]
            if not held_sources[number] & source_bit and not held_clusters[number] & cluster_bit:
                break
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[number] |= source_bit
        held_clusters[number] |= cluster_bit
        out.append((number, capacity - left))
        if left > length:
            insort(room, (left - length, number))
    return out


def _numbers(values: pd.Series) -> list[int]:
    """Small numbers for the values of a group, as places in a bitmap; -1 for null."""
    return pd.factorize(values, use_na_sentinel=True)[0].tolist()


def _packer(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "rank"], ascending=[False, True], kind="stable")
        found = best_fit(
            pieces["length"].tolist(), _numbers(pieces["source"]), _numbers(pieces["cluster"]), capacity
        )
        bins, offsets = np.array(found, np.int64).reshape(-1, 2).T
        out = pieces[["doc_id", "version", "copy", "piece", "start", "length"]].copy()
        out["bin_id"] = pieces["group"].to_numpy() * (1 << 32) + bins
        out["offset"] = offsets
        return out

    return run


def pack_documents(
    df: DataFrame,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cluster: Column | None = None,
    length: Column | None = None,
) -> DataFrame:
    """Where each piece of each document goes: a bin, and an offset in it.

    Columns: ``doc_id``, ``version`` (a hash of the text), ``copy`` (of rows that
    agree in id, text, source and cluster), ``piece``, ``start`` (in the document)
    and ``length`` in words or in the units of ``length``, ``bin_id``, ``offset``. No
    bin holds two pieces of one source or of one cluster; a null source
    conflicts with none. ``cluster`` defaults to equal texts but for case and
    blanks. A document of no words (null, empty) is a piece of length 0, which
    takes no room but a place in a bin. Ties are broken by a hash of the piece.
    The result does not depend on how the input is partitioned. Other columns
    are not looked at.
    """
    text = quoted(text_column).cast("string")
    cluster = cluster_of(text) if cluster is None else cluster
    length = word_count(text) if length is None else length
    docs = df.select(
        quoted(id_column).alias("doc_id"),
        F.xxhash64(text).alias("version"),
        quoted(source_column).cast("string").alias("source"),
        cluster.alias("cluster"),
        length.cast("bigint").alias("length"),
    )
    keys = ["doc_id", "version", "source", "cluster", "length"]
    scratch = Scratch(df.sparkSession)
    docs = scratch.table(docs.groupBy(*keys).agg(F.count("*").alias("copies")), "lengths")
    last = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)) - 1
    pieces = (
        docs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("length", F.least(F.col("length") - F.col("start"), F.lit(capacity)))
        .withColumn("rank", F.xxhash64("doc_id", "version", "source", "copy", "piece"))
    )
    count = docs.agg(F.sum(F.col("copies") * (last + 1))).first()[0] or 0
    groups = max(1, -(-count // GROUP))
    # The hash that deals is not the one that breaks ties.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), F.col("rank")), F.lit(groups))).drop("copies")
    kind = df.schema[id_column].dataType.simpleString()
    schema = (
        f"doc_id {kind}, version bigint, copy bigint, piece bigint, start bigint, length bigint, bin_id bigint, offset bigint"
    )
    return dealt.groupBy("group").applyInPandas(_packer(capacity), schema)
