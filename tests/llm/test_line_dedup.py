import re

import pytest
from brute import TEXTS, documents
from compare import compare, connect

from weirlog.llm import line_dedup
from weirlog.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[^\n]*?[.!?] |[^\n]*\n|[^\n]+")
LINES = [f"Line number {i} of a passage that is long enough." for i in range(12)]
PASSAGES = [
    "\n".join(LINES[:6]),
    "A start.\n" + "\n".join(LINES[2:5]) + "\nAn end.",
    " ".join(LINES[1:5]) + " And on it goes in one line.",
    "\n\n".join(LINES[:4]),
    "\n".join(LINES[:2]),
    "\n".join(LINES[6:9] * 3),
    "a.\nb.\nc.\nd.",
    "a.\nb.\nc.\nd.",
    "\n".join(LINES),
    "\r\n".join(LINES[3:7]) + "\r\n",
]


def brute(rows, min_chars=line_dedup.MIN_CHARS):
    """First places first; everything by comparing the texts of windows."""
    seen, out = {}, []
    done = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (doc_id, text) in done:
            out.append((doc_id, *done[doc_id, text]))
            continue
        units = UNIT.findall(text or "")
        assert "".join(units) == (text or "")
        filled = [i for i, u in enumerate(units) if u.strip(" \t\r\n")]
        gone = set()
        for k in range(len(filled) - 2):
            window = tuple(units[i].strip(" \t\r\n") for i in filled[k : k + 3])
            if sum(map(len, window)) < min_chars:
                continue
            if window in seen and seen[window] != (doc_id, k):
                gone.update((k, k + 1, k + 2))
            seen.setdefault(window, (doc_id, k))
        runs, cut = [], set()
        for k in sorted(gone):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        for a, b in runs:
            cut.update(range(filled[a], filled[b] + 1))
        kept = None if text is None else "".join(u for i, u in enumerate(units) if i not in cut)
        done[doc_id, text] = (kept, len(gone))
        out.append((doc_id, kept, len(gone)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("texts", [TEXTS, PASSAGES, PASSAGES * 2, TEXTS + PASSAGES])
def test_like_brute_force(spark, texts):
    df = documents(spark, texts, clashing=("cuts", "kept", "all", "N_CUT"))
    found = line_dedup.drop_repeated_lines(df)
    assert [c.lower() for c in found.columns] == [c.lower() for c in df.columns]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(repr((r["doc_id"], r["text"], r["n_cut"])) for r in found.collect()) == brute(rows)


def test_a_passage_inside_a_line_goes(spark):
    df = spark.createDataFrame(
        [(1, "Intro here. " + " ".join(LINES[:4]) + " Outro."), (2, "Else. " + " ".join(LINES[:4]) + " More.")],
        "doc_id bigint, text string",
    )
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}[2] == "Else. More."


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, texts=[])).count() == 0


def test_query_matches_sql(spark):
    assert compare(QUERIES["op9_line_dedup"](spark, SF), ORACLES["op9_line_dedup"], connect(SF)) is None
