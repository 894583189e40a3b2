import random
import re
from collections import Counter, defaultdict

import pytest
from brute import TEXTS, ascii_lower, documents

from weirlog.llm import phrases


def brute(rows, least=30, covered=80, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df):
    return [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]


def run(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def corpus(spark, n=300):
    draw = random.Random(6)
    fixed = ["new york city", "in order to", "State of the art", "à la carte", "日本 語 の"]
    rows = []
    for i in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else f"w{int(draw.paretovariate(1))}" for _ in range(40)]
        text = "".join(p + draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!? "]) for p in parts)
        rows.append((text, draw.choice(["en", "fr", None, "und", "x y"])))
    return spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize("dictionary", [1_000_000, 7, 0])
def test_like_brute_force(spark, dictionary):
    """With all frequent words in the dictionary, with some, and with none."""
    df = corpus(spark)
    expected = brute(rows_of(df), least=5, best=40)
    assert len(expected) > 60
    assert run(df, least=5, best=40, dictionary=dictionary) == expected


def test_awkward_texts(spark):
    df = documents(spark, TEXTS * 3, clashing=("n", "w1", "word", "rank"))
    assert run(df, least=2) == brute(rows_of(df), least=2)


def test_thresholds(spark):
    texts = ["a b c d e"] * 8 + ["a b"] * 2 + ["c d"] * 1 + ["b a b a b a"] * 3
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    for covered in (1, 79, 80, 81, 100):
        assert run(df, least=3, covered=covered) == brute(rows_of(df), least=3, covered=covered)


def test_nothing_frequent_and_empty(spark):
    df = spark.createDataFrame([("one two", None), (None, "en"), ("", "en")], "text string, lang string")
    assert run(df) == [] and run(df.where("false")) == []


def test_numbers_that_collide_are_tried_again(spark, monkeypatch):
    """With two bits of a hash the first seeds cannot tell the words apart."""
    df = corpus(spark, 60)
    plain = phrases._hashed
    tried = []

    def poor(lang, word, seed):
        tried.append(seed)
        return plain(lang, word, seed) if seed > 1 else plain(lang, word, seed).bitwiseAND(3)

    monkeypatch.setattr(phrases, "_hashed", poor)
    words = df.selectExpr("lang", "explode(split(text, ' ')) as word").where("lang is not null").distinct()
    assert phrases._seed(words, words["word"].isNull()) == 2 and tried[:3] == [0, 1, 2]
