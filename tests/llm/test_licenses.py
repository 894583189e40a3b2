import pytest
from brute import LONG, TEXTS, documents, kept_words

from weirlog.llm import licenses
from weirlog.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
MIT = next(t for label, t in licenses.NOTICES if label == "mit")


def base(text):
    found = kept_words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        for i in range(len(found) - len(wanted) + 1):
            if found[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return (
        len(found),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
    )


def check(rows, given):
    got = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    assert got == sorted(repr((i, *base(t))) for i, t in set(given))
    for r in rows:
        labels = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= labels
        assert r.labels == ",".join(sorted(labels)) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(labels)


def test_base_places(spark):
    texts = [*TEXTS, "under the MIT license " * 700, "cc by ncx by nc", "CC-BY-NC", "cc by", "apache license version 2" + LONG,
             "cc by cc by nc by nc"]
    df = documents(spark, texts, clashing=("pos", "hash", "score", "template"))
    check(licenses.summary(*licenses.scan(df)).collect(), [(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_notices_with_changes(spark, monkeypatch, few):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", few)
    found = MIT.split()
    put_in = " ".join(found[:12] + ["really", "and", "truly"] + found[12:])
    left_out = " ".join(found[:9] + found[11:])
    apart = " ".join(found[:12]) + " " + LONG + " " + " ".join(found[12:])
    texts = {
        1: "Intro. " + MIT.title() + " outro",
        2: "x " * 300 + put_in,
        3: left_out,
        4: apart,  # the two halves are far apart: neither is enough
        5: " ".join(found[:10]),
        6: MIT + " " + MIT,
        7: "This work is licensed under the GNU General Public License, version 3.",
        8: "All rights, reserved",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.summary(*licenses.scan(df)).collect()}
    assert {i: r.labels for i, r in rows.items()} == {
        1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "mit", 7: "gpl-3", 8: "reserved"
    }
    _, spans = licenses.scan(df)
    places = {(s.doc_id, s["first"], s["last"]) for s in spans.collect() if s.doc_id in (1, 2, 6)}
    n = len(found)
    assert {(1, 1, n), (2, 300, 300 + n + 2)} <= places
    assert sum(p[0] == 6 for p in places) in (1, 2)


def test_empty_table(spark):
    assert licenses.summary(*licenses.scan(documents(spark, texts=[]))).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op4_license_diagonals"](spark, SF).collect(), docs)
