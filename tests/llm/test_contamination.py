import random

import pytest
from brute import TEXTS, documents, kept_words
from compare import compare, connect

from weirlog.llm import contamination
from weirlog.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def item_shingles(text):
    found = kept_words(text)
    n = min(5, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def brute(docs, items, threshold=0.8):
    out = set()
    for doc_id, text in docs:
        found = kept_words(text)
        for item_id, item in items:
            wanted = item_shingles(item)
            n = len(next(iter(wanted))) if wanted else 0
            has = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()
            if wanted and len(wanted & has) >= threshold * len(wanted):
                shared = len(wanted & has)
                out.add((doc_id, item_id, len(wanted), shared, round(shared / len(wanted), 6)))
    return sorted(map(repr, out))


def planted(draw):
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 5, 6, 12, 30, 64, 130])))) for i in range(24)]
    items += [(100, None), (101, ""), (102, "?!"), (0, items[0][1]), (0, "another text with the id 0 again"), (None, "null id item of six words")]
    texts = list(TEXTS) + ["null id item of six words"]
    for _, item in items[:24] * 2:
        words = item.split()
        for at in range(len(words)):
            if draw.random() < 0.02:
                words[at] = "changed"
        around = draw.choices(vocabulary, k=draw.choice([0, 10, 3000]))
        texts.append(" ".join(around).upper() + ", " + "  ".join(words) + ". " + " ".join(around))
    return items, texts


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_like_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", broadcast_rows)
    items, texts = planted(random.Random(5))
    df = documents(spark, texts, clashing=("item_id", "item", "hash"))
    given = spark.createDataFrame(items, "item_id bigint, text string")
    found = contamination.find_items(df, given).drop("version").distinct()
    rows = [(r.doc_id, r.text) for r in df.collect()]
    expected = brute(rows, items)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    clean = contamination.without_items(df, given)
    assert clean.columns == df.columns
    bad = {eval(e)[0] for e in expected}
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(
        repr(i) for i, t in rows if not brute([(i, t)], items)
    )
    assert bad


def test_sketches_miss_nothing():
    """Whatever an item may lack, one of its sketch's hashes is left."""
    for n in range(1, 300):
        need = -(-4 * n // 5)
        assert contamination.sketch_size(n, 0.8) > n - need or contamination.sketch_size(n, 0.8) >= n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "five words are in here")], "item_id bigint, text string")
    assert contamination.find_items(documents(spark), none).count() == 0
    assert contamination.find_items(documents(spark, texts=[]), some).count() == 0


def test_query_matches_sql(spark):
    assert compare(QUERIES["op2_contained_items"](spark, SF), ORACLES["op2_contained_items"], connect(SF)) is None
