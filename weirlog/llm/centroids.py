"""Centroid clustering in whole numbers, with a table of distances to fixed pivots.

Components are floored to integers, so sums, distances and new centroids are exact
and do not depend on the order in which tasks are added up. The starting
centroids are also the pivots: each vector's distances to them are stored once,
with the vector. In a round the driver knows the distances of the centroids to the
pivots, and for every pivot the difference of the two is a lower bound of the
distance of a vector and a centroid. Only centroids whose greatest bound does not
exceed the best distance found so far receive an exact distance. Bounds are
floating point, less their rounding error; what they let through is decided in
integers.

A round sends the centroids to the tasks and gets a count and a sum per centroid
back from each, added up by Spark; the vectors stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted
from weirlog.session import Scratch

ROWS_AT_ONCE = 4096
SMALL = 1 << 27  # components below this have squared distances, at these widths, far below 64 bits
ROUNDING = 1e-14  # generous for a root, a difference and a square of doubles

def _unbounded(values: np.ndarray) -> np.ndarray:
    """Whole numbers as integers of any size."""
    return np.frompyfunc(int, 1, 1)(values)


def _integers(values: np.ndarray) -> np.ndarray:
    """Whole-numbered doubles as integers: of 64 bits where squares fit, else of any size."""
    if not values.size or np.abs(values).max() < SMALL:
        return values.astype(np.int64)
    return _unbounded(values)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    start, stop = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
    return lists.values.to_numpy(zero_copy_only=False)[start:stop].reshape(-1, width)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centre."""
    apart = points - centre
    return (apart * apart).sum(axis=1)


def nearest(points: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, centre_pivots: np.ndarray):
    """Number and squared distance of each point's nearest centre, and how many exact distances that took.

    ``to_pivots`` and ``centre_pivots`` are distances (not squared) to the same pivots.
    """
    here, there = to_pivots[:, None, :], centre_pivots[None, :, :]
    apart = np.abs(here - there) - ROUNDING * (here + there)
    bound = np.square(np.maximum(apart.max(axis=2), 0)) * (1 - ROUNDING)
    rows = np.arange(len(points))
    cluster = bound.argmin(axis=1)
    distance = np.zeros(len(points), points.dtype)
    made = len(points)
    for c in range(len(centres)):
        mine = cluster == c
        distance[mine] = squared(points[mine], centres[c])
    first = cluster.copy()
    for c in range(len(centres)):
        # Equal distances go to the smaller number, so a bound that equals the best one survives.
        left = rows[(first != c) & (bound[:, c] <= distance.astype(float) * (1 + ROUNDING))]
        made += len(left)
        found = squared(points[left], centres[c])
        better = (found < distance[left]) | ((found == distance[left]) & (c < cluster[left]))
        cluster[left[better]], distance[left[better]] = c, found[better]
    return cluster, distance, made


def _roots(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(points, c).astype(float)) for c in centres], axis=1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _with_pivots(pivots: list[list[int]], width: int):
    """The stored table: ids, integer vectors and their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.array(pivots, object)
        for block in _blocks(batches):
            roots = _roots(_integers(_matrix(block.column(1), width)), centres)
            ends = pa.array(np.arange(len(roots) + 1) * len(pivots), pa.int32())
            stored = pa.ListArray.from_arrays(ends, pa.array(roots.ravel()))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), stored], ["vec_id", "point", "pivots"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centres: list[list[int]], pivots: list[list[int]], width: int):
    exact = np.array(centres, object)
    if max(abs(x) for c in centres for x in c) < SMALL:
        exact = exact.astype(np.int64)
    between = _roots(exact, np.array(pivots, object))
    for block in _blocks(batches):
        points = _integers(_matrix(block.column(1), width))
        yield block, points, *nearest(points, _matrix(block.column(2), len(pivots)), exact, between)[:2]


def _sums(centres: list[list[int]], pivots: list[list[int]], width: int):
    """Per task and cluster the number of vectors and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centres), np.zeros((len(centres), width), object)
        for _, points, cluster, _ in _assigned(batches, centres, pivots, width):
            for c in np.unique(cluster):
                mine = points[cluster == c]
                counts[c] += len(mine)
                sums[c] += _unbounded(mine.sum(axis=0))
        at = [c for c, n in enumerate(counts) if n]
        totals = pa.array([[Decimal(x) for x in sums[c]] for c in at], pa.list_(pa.decimal128(38)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([counts[c] for c in at], pa.int64()), totals], ["cluster", "n", "sums"]
        )

    return run


def _labels(centres: list[list[int]], pivots: list[list[int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, cluster, distance in _assigned(batches, centres, pivots, width):
            far = pa.array(distance.tolist(), pa.int64())  # raises where a distance does not fit
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(cluster, pa.int32()), far], ["vec_id", "cluster", "distance"]
            )

    return run


def cluster_vectors(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    scale: float = 1024.0,
    width: int = 64,
    seed: int = 3,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """Each vector's ``cluster`` and squared ``distance``, and the final centroids.

    Vectors of exactly ``width`` components, none null or non-finite, take part,
    with components floor(scale * x). The ``k`` vectors of smallest SHA-256 of
    ``seed:id`` start, in that order; a null id is hashed as an empty one, and
    rows that share an id are ordered by their components. With fewer vectors
    there are fewer centroids, with none the result is empty. Each of ``rounds``
    rounds assigns every vector to its nearest centroid, ties to the smaller
    number, and moves each centroid to the floor of its vectors' mean; one
    without vectors stays. Rows that repeat count as often as they occur. A
    distance or a component beyond 64 bits is an error. Other columns are not
    looked at.
    """
    spark = df.sparkSession
    vector = quoted(vector_column).cast("array<double>")
    usable = (F.size(vector) == width) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    kept = df.where(quoted(vector_column).isNotNull() & usable)
    number = quoted(id_column).cast("bigint")
    scaled = F.transform(vector, lambda x: F.lit(scale) * x)
    whole = F.transform(
        scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    )  # beyond 2^53 a double has no fraction
    rows = kept.select(number.alias("vec_id"), whole.alias("point"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = rows.orderBy(order, "vec_id", "point").limit(k).collect()
    centres = [[int(x) for x in row["point"]] for row in starts]
    with Scratch(spark) as scratch:
        labels = Scratch(spark)  # what the result reads
        if not centres:
            empty = spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint")
            return empty, centres
        pivots = centres
        stored = scratch.table(
            rows.mapInArrow(_with_pivots(pivots, width), "vec_id bigint, point array<double>, pivots array<double>"),
            "pivot-table",
        )
        for _ in range(rounds):
            parts = stored.mapInArrow(_sums(centres, pivots, width), "cluster int, n bigint, sums array<decimal(38,0)>")
            added = (
                parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
                .groupBy("cluster", "at")
                .agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
                .collect()  # k x width numbers
            )
            centres = [list(c) for c in centres]
            for row in added:
                centres[row["cluster"]][row["at"]] = int(row["total"]) // row["n"]
        found = stored.mapInArrow(_labels(centres, pivots, width), "vec_id bigint, cluster int, distance bigint")
        return labels.table(found, "clusters"), centres


def with_inertia(labels: DataFrame, centres: list[list[int]]) -> DataFrame:
    """``labels`` with ``cluster_inertia`` and ``inertia``, the summed distances, and ``centroid_sha256``."""
    spark = labels.sparkSession
    sums = {r["cluster"]: r["total"] for r in labels.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    everything = sum(sums.values())
    rows = [
        (c, sums.get(c, 0), everything, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest())
        for c, centre in enumerate(centres)
    ]
    # One row per centroid.
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return labels.join(F.broadcast(about), "cluster").select(columns)
