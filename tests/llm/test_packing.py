import random

import pytest
from brute import documents
from pyspark.sql import functions as F

from weirlog.llm import packing
from weirlog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def slow_best_fit(lengths, sources, clusters, capacity):
    """The tightest compatible bin by looking at all of them; the lower number among equals."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [
            (b["room"], i)
            for i, b in enumerate(bins)
            if b["room"] >= n and b["room"] > 0 and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["room"]))
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_like_looking_at_all_bins(seed):
    draw = random.Random(seed)
    n = 400
    lengths = [draw.choice([0, 1, 5, 30, 64, draw.randint(0, 100)]) for _ in range(n)]
    if seed % 2:
        lengths.sort(reverse=True)
    sources = [0 if draw.random() < 0.33 else draw.randint(-1, 20) for _ in range(n)]
    clusters = [0 if draw.random() < 0.1 else draw.randint(-1, 300) for _ in range(n)]
    assert packing.best_fit(lengths, sources, clusters, 100) == slow_best_fit(lengths, sources, clusters, 100)


def check(df, rows, capacity):
    given = df.select("doc_id", packing.word_count(F.col("text")).alias("n"), "source").collect()
    assert sum(r["length"] for r in rows) == sum(g.n for g in given)
    expected = sorted(repr((g.doc_id, p)) for g in given for p in range(max(1, -(-g.n // capacity))))
    assert sorted(repr((r["doc_id"], r["piece"])) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for held in bins.values():
        held = sorted(held, key=lambda r: (r["offset"], r["length"]))
        end = 0
        for r in held:
            assert r["offset"] == end and r["start"] == r["piece"] * capacity
            end += r["length"]
        assert end <= capacity
    source = {}
    for g in given:
        source.setdefault(g.doc_id, g.source)
    for held in bins.values():
        named = [source[r["doc_id"]] for r in held if r["doc_id"] is not None and source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    return bins


@pytest.mark.parametrize("group", [2048, 3])
def test_awkward_rows(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    df = documents(spark, clashing=("piece", "bin_id", "length", "group", "copies"))
    check(df, packing.pack_documents(df, capacity=500).collect(), 500)


def test_copies_go_to_different_bins(spark):
    rows = [(i, "same  Words here" if i % 3 == 0 else f"text {i} of more", None) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:1] * 50, "doc_id bigint, text string, source string")
    bins = check(df, packing.pack_documents(df, capacity=40).collect(), 40)
    for held in bins.values():
        assert sum(r["doc_id"] % 3 == 0 for r in held) <= 1


def test_the_result_does_not_depend_on_partitions(spark):
    df = documents(spark)
    one = packing.pack_documents(df.coalesce(1), capacity=500).collect()
    many = packing.pack_documents(df.repartition(7), capacity=500).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, texts=[])).count() == 0


def test_query_fills_bins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op10_best_fit_bins"](spark, SF).collect()
    check(docs, rows, packing.CAPACITY)
    n_bins = len({r["bin_id"] for r in rows})
    assert sum(r["length"] for r in rows) / packing.CAPACITY / n_bins > 0.9
