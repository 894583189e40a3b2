import zlib

from brute import LONG, documents
from pyspark.sql import functions as F

from weirlog.llm import sharding
from weirlog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def check(df, n, slack):
    """Sizes, gapless slots and balance, by plain recount."""
    rows = sharding.shards(df, n).collect()
    assert len(rows) == df.count()
    held = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        held.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < n for s in held)
    for members in held.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total = sum(r["size"] for r in rows)
    for s in range(n):
        assert abs(sum(r["size"] for r in held.get(s, [])) - total / n) <= slack
    return rows


def test_awkward_rows(spark):
    df = documents(spark, clashing=("size", "Shard", "slot", "key", "part"))
    rows = check(df, 3, 2 * len(LONG) + 100)
    assert {"size", "shard", "slot"} <= set(rows[0].asDict()) and rows[0]["key"] == "clash"
    assert "Shard" not in rows[0].asDict()


def test_a_text_that_makes_up_a_third_is_cut(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
    )
    rows = check(df, 7, 60)
    # Equal texts stand on neighbouring shards.
    same = sorted({r["shard"] for r in rows if r["text"] == "same text"})
    assert same == list(range(same[0], same[-1] + 1))


def test_several_parts_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 2000)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    check(df, 5, 60)


def test_few_cells_take_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 64)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    check(df, 5, 60)


def test_empty_table(spark):
    assert sharding.shards(documents(spark, texts=[]), 4).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_histogram_shards"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    largest = max(r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    sums = {}
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode()))
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert all(abs(sums.get(s, 0) - total / 40) <= largest for s in range(40))
