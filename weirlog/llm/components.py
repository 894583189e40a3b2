"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.session import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b of one batch as stars: each node but the smallest of its component, and that one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (columns ``u``, ``v``) with the smallest node it reaches, ``root``.

    Alternating large and small stars: every node hands its larger, then its
    smaller neighbours to the smallest one, until all components are stars.
    The smallest neighbours are an aggregate that is combined before its
    shuffle; they are written down, so that the join that follows has two plain
    sides and Spark can split a node with very many edges. The edge table of
    each round is written to the shared folder and the one before removed.
    """
    spark = edges.sparkSession

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())

    with Scratch(spark) as first:
        stars = first.table(tidy(edges), "edges")
        scratch = first
        before = state(stars)
        while True:
            own = Scratch(spark)
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = own.table(both.groupBy("u").agg(F.min("v").alias("least")), "least")
            large = both.join(least, "u").where("v > u").select(
                F.col("v").alias("u"), F.least("u", "least").alias("v")
            )
            large = own.table(tidy(large), "large")
            least = own.table(large.groupBy("u").agg(F.min("v").alias("least")), "least")
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
            small = small.unionByName(least.select("u", F.col("least").alias("v")))
            after = Scratch(spark)
            stars = after.table(tidy(small), "stars")
            own.__exit__()
            scratch.__exit__()
            scratch = after
            now = state(stars)
            if now == before:
                break
            before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
