import random

import numpy as np
import pytest
from brute import documents, groups, simhash
from pyspark.sql import functions as F

from weirlog.llm import simhash as operator
from weirlog.llm.components import components, forest


def test_fingerprints_and_components(spark):
    df = documents(spark, clashing=("fingerprint", "component_id", "fp", "version"))
    found = operator.near_duplicates(df)
    rows = found.select("doc_id", "fingerprint", "component_id").collect()
    texts = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(repr, ((r.doc_id, r.fingerprint) for r in rows))) == sorted(
        repr((i, f"{simhash(t):016x}")) for i, t in texts
    )
    prints = sorted({simhash(t) for _, t in texts})
    root = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, t in texts:
        if i is not None:
            r = root[simhash(t)]
            least[r] = min(i, least.get(r, i))
    assert {(r.fingerprint, r.component_id) for r in rows} == {
        (f"{p:016x}", least.get(root[p])) for p in prints
    }


@pytest.mark.parametrize("seed", range(4))
def test_links_of_planted_fingerprints(spark, seed):
    """Dense balls, chains and lone values: the same components as comparing all pairs."""
    draw = random.Random(seed)
    values = {draw.getrandbits(64) for _ in range(40)}
    for centre in list(values)[:6]:
        for _ in range(60):
            near = centre
            for b in draw.sample(range(64) if seed % 2 else range(32), draw.randint(1, 3)):
                near ^= 1 << b
            values.add(near)
            if draw.random() < 0.3:
                centre = near
    values |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 7}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r.node: r.root for r in components(operator.links(fps)).collect()}
    nodes = sorted(signed)
    expected = groups(nodes, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert {n: found.get(n, n) for n in nodes} == expected


def test_batches_split_at_keys_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(operator, "LOCAL_VALUES", 33 * 50)
    test_links_of_planted_fingerprints(spark, 9)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 80)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_forest():
    node, root = forest(np.array([5, 3, 9, 8]), np.array([3, 1, 8, 9]))
    assert dict(zip(node.tolist(), root.tolist())) == {3: 1, 5: 1, 9: 8}


def test_one_of_each_stays(spark):
    df = documents(spark, clashing=("row", "keep_id"))
    kept = operator.keep_one_of_each(df)
    assert kept.columns == df.columns
    found = operator.near_duplicates(df).select("component_id", F.col("fingerprint")).collect()
    nameless = {r.fingerprint for r in found if r.component_id is None}
    expected = {r.component_id for r in found if r.component_id is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert sum(i is None for i in ids) == len(nameless)


def test_empty_table(spark):
    df = documents(spark, texts=[])
    assert operator.near_duplicates(df).count() == 0
    assert operator.keep_one_of_each(df).count() == 0
