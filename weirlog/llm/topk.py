"""Exact top-k by inner product, with the kth score found in global histograms.

Every query is scored against every row, in blocks: a block of queries of
bounded size is sent to the tasks, which score their rows against it by a matrix
product. A round counts the scores of each query in equal steps over the interval
that holds its kth value; the sums over all tasks give the step it lies in, which
is the next round's interval, until a step is one score wide. A last pass keeps
the scores above the kth value, and of those equal to it the smallest ids.

Scores are counted again in each round instead of being stored: a product costs
less than writing queries x rows. A task reports the steps down to its own
kth score only, since the global one cannot be lower.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted
from weirlog.session import Scratch, new_folder

BLOCK_BYTES = 4 << 20  # of a block of queries
ROWS_AT_ONCE = 1024
STEPS = 512
EXACT = 1 << 53


def _vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled, floored vectors of a batch; shorter vectors are filled up with zeros."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    values = np.floor(scale * lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64))
    if not len(sizes):
        return ids, np.zeros((0, 0))
    out = np.zeros((len(sizes), int(sizes.max())))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return ids, out


def _scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    width = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :width], rows[:, :width]
    if exact:
        return (queries @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = whole(queries).dot(whole(rows).T) if width else np.zeros((len(queries), len(rows)), object)
    return out.astype(np.int64)  # raises where a score does not fit


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield _vectors(batch.slice(at, ROWS_AT_ONCE), scale)


def _count_steps(block, k: int, scale: float) -> Callable:
    """Counts of scores per query and step, down to the step of the task's own kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, low, span, step, need, exact = block.value
        counts = np.zeros((len(ids), STEPS), np.int64)
        base = np.arange(len(ids))[:, None] * STEPS
        for row_ids, rows in _blocks(batches, scale):
            at = _scores(vectors, rows, exact) - low[:, None]
            inside = (at >= 0) & (at < span) & (row_ids[None, :] != ids[:, None])
            counts += np.bincount((at // step + base)[inside], minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, at = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[query, at])],
            ["query", "step", "n"],
        )

    return run


def _pick(block, k: int, scale: float) -> Callable:
    """Rows above the kth score of each query, and the smallest ids of those equal to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, kth, exact = block.value
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["query_id", "vec_id", "score"]

        def smallest() -> tuple[np.ndarray, np.ndarray]:
            query, tied = (np.concatenate(x) for x in zip(*ties))
            order = np.lexsort((tied, query))
            query, tied = query[order], tied[order]
            starts = np.searchsorted(query, query)
            keep = np.arange(len(query)) - starts < k
            return query[keep], tied[keep]

        for row_ids, rows in _blocks(batches, scale):
            scores = _scores(vectors, rows, exact)
            other = row_ids[None, :] != ids[:, None]
            query, row = np.nonzero((scores > kth[:, None]) & other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[query]), pa.array(row_ids[row]), pa.array(scores[query, row])], names
            )
            query, row = np.nonzero((scores == kth[:, None]) & other)
            if len(query):
                ties.append((query, row_ids[row]))
                if len(ties) > 16:
                    ties[:] = [smallest()]
        if ties:
            query, tied = smallest()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(tied), pa.array(kth[query])], names)

    return run


def top_k(
    df: DataFrame,
    is_query,
    k: int = 5,
    scale: float = 256.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of highest score for each row for which ``is_query(id)`` holds.

    A vector's components are floor(scale * x) and a score is the integer inner
    product; vectors of unequal length are compared as if filled up with
    zeros. Result: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to
    the smaller id, and fewer rows come where there are fewer candidates. Null
    ids, null vectors and vectors with a null or non-finite component take no
    part; an empty vector scores zero. Rows that share an id are all candidates
    of others and none of each other; as a query their smallest vector counts.
    Scores beyond 64 bits raise an error. Other columns are not looked at.
    """
    spark = df.sparkSession
    vector = quoted(vector_column).cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(quoted(id_column).isNotNull() & quoted(vector_column).isNotNull() & usable).select(
        quoted(id_column).cast("bigint").alias("vec_id"), vector.alias("vector")
    )
    scratch = Scratch(spark)
    rows = scratch.table(rows, "vectors")
    whole = F.transform("vector", lambda x: F.abs(F.lit(scale) * x) + 1)
    largest = F.coalesce(F.array_max(whole), F.lit(0.0))
    norm = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
    shape = rows.agg(
        F.count_if(is_query(F.col("vec_id"))).alias("queries"),
        F.max(F.size("vector")).alias("width"),
        F.max(largest).alias("largest"),
        F.max(norm).alias("norm"),
    ).first()
    width = max(1, shape["width"] or 0)
    exact = (shape["largest"] or 0.0) ** 2 * width < EXACT
    bound = math.ceil((shape["norm"] or 0.0) ** 2 * (1 + 1e-9)) + 1
    n_blocks = -(-(shape["queries"] or 0) * 8 * width // BLOCK_BYTES)
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    results = new_folder(spark, "top")
    schema = "query_id bigint, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{results}/block=-1")
    for number in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == number)
        batches = mine.toArrow().combine_chunks().to_batches()
        if not batches:
            continue
        ids, vectors = _vectors(batches[0], scale)
        low = np.full(len(ids), -bound, np.int64)
        span = 2 * bound + 1
        need = np.full(len(ids), k, np.int64)
        settled = False
        while not settled:
            step = -(-span // STEPS)
            block = spark.sparkContext.broadcast((ids, vectors, low, span, step, need, exact))
            counted = rows.mapInArrow(_count_steps(block, k, scale), "query int, step int, n bigint")
            counted = counted.groupBy("query", "step").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("query").orderBy(F.desc("step"))
            upto = counted.withColumn("upto", F.sum("n").over(down))
            needed = F.element_at(F.from_json(F.lit(str(need.tolist())), "array<bigint>"), F.col("query") + 1)
            found = (
                upto.where(F.col("upto") >= needed)
                .groupBy("query")
                .agg(F.max("step").alias("step"), F.max_by(F.col("upto") - F.col("n"), "step").alias("above"))
                .collect()
            )
            block.unpersist()
            at = {row["query"]: row for row in found}
            # A query with fewer than k candidates takes all of them.
            for i in range(len(ids)):
                if i in at:
                    low[i] += at[i]["step"] * step
                    need[i] -= at[i]["above"]
            settled, span = step == 1, step
        block = spark.sparkContext.broadcast((ids, vectors, low, exact))
        picked = rows.mapInArrow(_pick(block, k, scale), schema)
        picked.write.parquet(f"{results}/block={number}")
        block.unpersist()
    scratch.__exit__()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(schema).parquet(results).select("query_id", "vec_id", "score")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
