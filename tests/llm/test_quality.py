import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute import documents
from pyspark.sql import functions as F

from weirlog.llm import hashes, quality
from weirlog.llm.catalog import QUERIES, trusted_ids
from weirlog.session import Scratch

SF = "/root/testdata/sf0.01"


def tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", text or "")


def discounts(counts):
    n = Counter(min(c, 5) for c in counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.0
    raw = (
        1 - 2 * y * n[2] / n[1] if n[1] else 0.5,
        2 - 3 * y * n[3] / n[2] if n[2] else 1.0,
        3 - 4 * y * n[4] / n[3] if n[3] else 1.5,
    )
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        pairs = Counter()
        for t in texts:
            words = ["", *tokens(t), ""]
            pairs.update(zip(words, words[1:]))
        total, follows = Counter(), Counter()
        for (v, w), c in pairs.items():
            total[v] += c
            follows[w] += 1
        d, e = discounts(pairs.values()), discounts(follows.values())
        self.seen = {(v, w): (c - d[min(c, 3) - 1]) / total[v] for (v, w), c in pairs.items() if c >= quality.CUTOFF}
        own = {w: (c - e[min(c, 3) - 1]) / len(pairs) for w, c in follows.items()}
        self.unknown = (1 - sum(own.values())) / (len(follows) + 1)
        self.own = own
        self.used = defaultdict(float)
        for (v, _), p in self.seen.items():
            self.used[v] += p

    def cost(self, text):
        words = ["", *tokens(text), ""]
        return [
            -math.log(
                self.seen.get((v, w), 0.0) + (1 - self.used.get(v, 0.0)) * (self.own.get(w, 0.0) + self.unknown)
            )
            for v, w in zip(words, words[1:])
        ]


@pytest.mark.parametrize("rows", [4_000_000, 40_000, 0])
def test_costs_like_a_plain_model(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = docs.where("doc_id % 3 = 0")
    plain = Plain([r.text for r in train.collect()])
    model = quality.Model(train, Scratch(spark))
    assert model.unknown == pytest.approx(plain.unknown, rel=1e-9)
    some = {r.doc_id: r.text for r in docs.where("doc_id < 150").collect()}
    for r in model.scores(docs.where("doc_id < 150"), "doc_id").collect():
        expected = plain.cost(some[r.doc_id])
        assert r.n_tokens == len(expected)
        assert r.cost / quality.MICRO == pytest.approx(sum(expected), abs=len(expected) * 1e-6 + 1e-6)


def test_probabilities_sum_to_one(spark):
    texts = [f"the {a} {b} of the {a}" for a in ("cat", "dog", "cow") for b in ("sat", "ran")] * 2
    plain = Plain(texts)
    words = {w for t in texts for w in [*tokens(t), ""]}
    for v in ("", "the", "cat", "of"):
        # Over the known words and one unknown word.
        known = sum(math.exp(-0) * (plain.seen.get((v, w), 0) + (1 - plain.used.get(v, 0)) * (plain.own.get(w, 0) + plain.unknown)) for w in words)
        assert known + (1 - plain.used.get(v, 0)) * plain.unknown == pytest.approx(1)


def test_labels(spark):
    """Held against the labels: good documents stay, most of the junk goes."""
    rows = QUERIES["op8_kneser_ney_quality"](spark, SF).collect()
    keep = {r.doc_id: r.keep for r in rows}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [keep[x.doc_id] for x in labels if x.quality == 1]
    bad = [keep[x.doc_id] for x in labels if x.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) < 0.35
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_limits_by_language(spark, monkeypatch):
    rows = QUERIES["op8_kneser_ney_quality"](spark, SF).collect()
    assert len({r.threshold for r in rows}) == 1  # too few held-out documents to tell languages apart
    monkeypatch.setattr(quality, "ENOUGH", 3)
    rows = QUERIES["op8_kneser_ney_quality"](spark, SF).collect()
    assert len({(r.lang, r.threshold) for r in rows}) == len({r.threshold for r in rows}) == 4


def test_awkward_rows(spark):
    df = documents(spark, clashing=("keep", "threshold", "score", "v", "w", "version"))
    ids = spark.createDataFrame([(1,), (4,), (4,), (9,), (13,), (None,)], "doc_id bigint")
    judged = quality.judge(df, ids).collect()
    assert {repr(r.doc_id) for r in judged} == {repr(r.doc_id) for r in df.collect()}
    empty = [r for r in judged if r.n_tokens == 1]
    assert empty and all(r.keep for r in empty)
    kept = quality.keep_good(df, ids)
    assert kept.columns == df.columns
    good = {(r.doc_id, r.version, r.lang) for r in judged if r.keep}
    expected = [r for r in df.withColumn("hash", F.xxhash64("text")).collect() if (r.doc_id, r["hash"], r.lang) in good]
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(
        repr(r) for r in spark.createDataFrame([(r.doc_id, r.text) for r in expected], "doc_id bigint, text string").collect()
    )


def test_without_trusted_documents_all_stay(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    df = documents(spark)
    assert quality.keep_good(df, none).count() == df.count()
    assert all(r.threshold is None for r in quality.judge(df, none).collect())
    assert quality.judge(documents(spark, texts=[]), none).count() == 0


@pytest.mark.parametrize("rows", [4_000_000, 20, 0])
def test_rare_pairs_are_kept(spark, monkeypatch, rows):
    """Pairs seen once or twice have a probability of their own."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", rows)
    texts = ["a b c d", "a b c e", "a b d e", "e d c b", "b a", "c a d b e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = quality.Model(df, Scratch(spark))
    pairs = {p for t in texts for p in zip(["", *tokens(t)], [*tokens(t), ""])}
    assert model.pairs.count() == len(pairs)
    asked = spark.createDataFrame([(1, "e d c b"), (2, "a c e a")], "doc_id bigint, text string")
    seen, unseen = (r.cost for r in model.scores(asked, "doc_id").orderBy("doc_id").collect())
    assert seen < unseen


def test_repeated_rows_count_once(spark):
    texts = ["a b c d", "a b c e", "e d c b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    one = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality.Model(one, Scratch(spark))
    expected = sorted(model.scores(one, "doc_id").collect())
    assert [r.n_tokens for r in expected] == [5, 5, 5]
    many = spark.createDataFrame(rows + rows[1:] * 2, "doc_id bigint, text string")
    assert sorted(model.scores(many, "doc_id").collect()) == expected


def test_documents_take_turns(spark, monkeypatch):
    """The tokens of one part of the documents are shuffled at a time, with the same sums."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 1000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200").select("doc_id", "text")
    model = quality.Model(docs.where("doc_id % 3 = 0"), Scratch(spark))
    whole = sorted(model.scores(docs, "doc_id").collect())
    parts, table = [], model.scratch.table

    def written(df, label):
        out = table(df, label)
        if label == "costs":
            parts.append({r.doc for r in out.collect()})
        return out

    monkeypatch.setattr(model.scratch, "table", written)
    monkeypatch.setattr(quality, "ROUND_ROWS", 40)
    assert sorted(model.scores(docs, "doc_id").collect()) == whole
    assert len(parts) == 6 and all(parts) and sum(map(len, parts)) == len(set.union(*parts)) == len(whole)


def test_hashes_are_those_of_spark(spark):
    rng = np.random.default_rng(8)
    v, w = (rng.integers(-(2**63), 2**63, 1000, np.int64) for _ in range(2))
    v[:4], w[:4] = [0, -1, 2**63 - 1, -(2**63)], [0, 0, -1, 1]
    rows = spark.createDataFrame(list(zip(v.tolist(), w.tolist())), "v bigint, w bigint")
    rows = rows.select(F.xxhash64("v", "w").alias("long"), F.hash("v", "w").alias("int"), F.hash("v").alias("one")).collect()
    v, w = v.view(np.uint64), w.view(np.uint64)
    assert [r.long for r in rows] == hashes.xxhash64(v, w).view(np.int64).tolist()
    assert [r.int for r in rows] == hashes.murmur(v, w).view(np.int32).tolist()
    assert [r.one for r in rows] == hashes.murmur(v).view(np.int32).tolist()


def test_lookup_and_filter(spark):
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(-(2**63), 2**63, 3000, np.int64))
    keys = np.concatenate([keys, [0, -1]])
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys.tolist())], "key bigint, n bigint")
    others = np.setdiff1d(rng.integers(-(2**63), 2**63, 3000, np.int64), keys)
    for known, rows in ((keys[:-1], table.where("key <> -1")), (keys, table), (keys[:0], table.limit(0))):
        there, n = quality._Lookup(rows).find(known.view(np.uint64))
        assert there.all() and n.tolist() == list(range(len(known)))
        there, n = quality._Lookup(rows).find(np.append(others, -1 if len(known) < len(keys) else 1).view(np.uint64))
        assert not there.any() and not n.any()
    parted = table.select("key", F.pmod(F.hash("key"), F.lit(7)).alias("part"))
    for blocks in (100, 30, 0):
        rare = quality._Filter(parted, len(keys), blocks, 7, Scratch(spark))
        assert rare.may(keys.view(np.uint64), keys.view(np.uint64)).all()
        passed = rare.may(others.view(np.uint64), others.view(np.uint64)).mean()
        assert passed == 1 if blocks == 0 else passed < 0.7
