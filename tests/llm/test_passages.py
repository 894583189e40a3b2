import random
import re

import pytest
from brute import TEXTS, documents
from pyspark.sql import functions as F

from weirlog.llm import passages

LAST = (1 << 63) - 1


def brute(rows, window=13):
    """Per row the words that stay and the number that goes, by comparing the words themselves."""
    split = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < i:
                gone.update(range(at, at + window))
        out.append((" ".join(w for at, w in enumerate(words) if at not in gone), len(words), len(gone)))
    return out


def run(df, **options):
    rows = passages.drop_repeated_passages(df, **options)
    return sorted((r["doc_id"] is None, r["doc_id"], r["kept"], r["n_words"], r["n_removed"]) for r in rows.collect())


def expected(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    return sorted((i is None, i, *found) for (i, _), found in zip(rows, brute(rows)))


def test_awkward_texts(spark):
    df = documents(spark, clashing=("kept", "n_words", "id", "version", "row", "cuts"))
    assert run(df) == expected(df)


def test_passages_that_meet(spark):
    """Copies, copies with words changed, passages put together, periodic texts and repeats inside a text."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(400)}"
    sources = [[word() for _ in range(draw.randrange(5, 160))] for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            source = list(draw.choice(sources))
            i, j = sorted(draw.randrange(len(source) + 1) for _ in range(2))
            parts += source[i:j] if draw.random() < 0.6 else [word() for _ in range(draw.randrange(30))]
        if parts and draw.random() < 0.5:
            parts[draw.randrange(len(parts))] = "changed"
        texts.append(draw.choice([" ", "\n", " \t"]).join(parts))
    texts += ["a b " * 50, "a b " * 40 + "c", "b " * 60, "b " * 13, "b " * 12]
    rows = [(i * 7 % 95, t) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[9]), (-5, texts[20]), (None, texts[21])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == expected(df)


def test_late_documents_share_what_the_first_lacks(spark):
    """The grams are the first document's, the window around them is not."""
    common = [f"c{i}" for i in range(9)]
    a = ["x"] * 20 + common + ["y"] * 20
    b = [f"l{i}" for i in range(20)] + common + [f"r{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(b)), (4, " ".join(b[10:35]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == expected(df)


@pytest.mark.parametrize("name, value", [("SHARD_WORDS", 5), ("BLOCK_WORDS", 40), ("PIECES", 3), ("TEXT_BYTES", 100)])
def test_split_shards_change_nothing(spark, monkeypatch, name, value):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id bigint, text string")
    monkeypatch.setattr(passages, name, value)
    assert run(df) == expected(df)


def test_automaton_in_parts(monkeypatch):
    monkeypatch.setattr(passages, "PIECES", 3)
    draw = random.Random(2)
    words = [f"w{draw.randrange(9)}" for _ in range(400)]
    shards = list(passages._shards([(1, " ".join(words))], 13))
    assert len(shards) > 3
    known, late = bytearray(388), bytearray(388)
    for shard in shards:
        shard.mark(2, words, 13, known, late)
    assert known == late == b"\1" * 388


def test_empty_table(spark):
    df = documents(spark, []).where("false").withColumn("more", F.lit(1))
    rows = passages.drop_repeated_passages(df)
    assert rows.collect() == [] and rows.columns == [*df.columns, "kept", "n_words", "n_removed"]


def test_words_of_bytes():
    import pyarrow as pa

    texts = [None, "", "  a\tb\x0b\x0cc\r\nd  ", "é\x85 \xa0x \x1c", "no", "blanks"]
    words = passages.Words(pa.array([t.encode() if t is not None else None for t in texts], pa.binary()).slice(0))
    found = [[words.text(i, i + 1) for i in range(a, b)] for a, b in zip(words.bounds, words.bounds[1:])]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
