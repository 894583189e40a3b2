import math
import random

import pytest
from pyspark.sql import functions as F

from weirlog.llm import topk
from weirlog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
THIRD = lambda i: F.pmod(i, F.lit(3)) == 0


def brute(rows, is_query, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    queries = {}
    for i, v in whole:
        if is_query(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, vq in queries.items():
        found = sorted((-sum(a * b for a, b in zip(vq, v)), i) for i, v in whole if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    return sorted(map(tuple, topk.top_k(df, THIRD, k).collect()))


@pytest.mark.parametrize("bad", [False, True])
def test_like_brute_force(spark, bad):
    draw = random.Random(1)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # many ties
    rows += [(3, rows[3][1]), (6, [0.0] * 8)]  # ids that repeat
    if bad:
        rows += [(None, [1.0] * 8), (300, None), (303, [1.0, None]), (306, [math.nan]), (309, [math.inf] * 8),
                 (312, []), (315, [5.0]), (-9, [1.0] * 12)]
    rows = [(i, None if v is None else [None if x is None else float(f"{x:.3g}") for x in v]) for i, v in rows]
    import numpy as np

    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(plain, lambda i: i % 3 == 0, 5)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 300)
    monkeypatch.setattr(topk, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(topk, "STEPS", 8)
    test_like_brute_force(spark, False)


def test_large_components(spark):
    rows = [(i, [float(2**20 + i), -float(2**19)]) for i in range(9)]
    assert run(spark, rows, 3) == brute(rows, lambda i: i % 3 == 0, 3)


def test_few_and_none(spark):
    assert run(spark, [(3, [1.0])]) == []
    assert run(spark, [(3, [1.0]), (4, [-1.0])]) == [(3, 1, 4, -65536)]
    assert run(spark, [(4, [1.0])]) == []
    assert run(spark, []) == []


def test_query(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op7_exact_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 50 == 0, 5)
