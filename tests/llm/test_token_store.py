import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import TEXTS, documents
from tokenizers import Tokenizer

from weirlog.llm import token_store
from weirlog.llm.catalog import QUERIES
from weirlog.session import new_folder

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = ["", " ", "\n\n a", "it's 'll 's 've", "a  b   c ", "x²³ 12½ ŉ ǆ ª", "­soft\x1cx\x85y", "tab\t\tx\r\n", "<|endoftext|>",
       "'tis''s", "é" * 50, "  wide", "a b", "😀 smile 12,345.67!!", " leading", "Ünï cödé"]


@pytest.mark.parametrize("remembered", [300_000, 20])
def test_encoder_gives_what_the_library_gives(monkeypatch, remembered):
    monkeypatch.setattr(token_store, "REMEMBERED", remembered)
    encoder = token_store.Encoder(PATH)
    texts = ODD + [t or "" for t in TEXTS]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == library(texts)


def test_pieces_are_cut_like_the_library_does():
    draw = random.Random(3)
    chars = ["'", "'s", "'re", "'ll", "'ve", "d", "S", "l", "é", "ɏ", "ª", "²", "1", " ", "  ", "\t", "\n", "\r", "!", "-", "¡", "×"]
    texts = ["".join(draw.choices(chars, k=draw.randrange(25))) for _ in range(5000)]
    encoder = token_store.Encoder(PATH)
    assert all(map(encoder._simple, texts))
    assert [x.tolist() for x in encoder.encode(texts)] == library(texts)


def test_a_piece_is_looked_up_once_however_often_it_occurs():
    class Counting(dict):
        looked_up = 0

        def get(self, *key):
            self.looked_up += 1
            return super().get(*key)

    encoder = token_store.Encoder(PATH)
    encoder.known = Counting()
    texts = ["One and one and one. " * 200] * 3
    assert [x.tolist() for x in encoder.encode(texts)] == library(texts)
    assert encoder.known.looked_up < 10


def test_a_batch_is_encoded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(token_store, "BYTES_AT_ONCE", 20)
    test_round_trip(spark)


def test_other_tokenizers_are_not_cut(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert [x.tolist() for x in token_store.Encoder(path).encode(ODD)] == library(ODD, path)


def test_round_trip(spark):
    df = documents(spark, TEXTS + ODD, clashing=("ids", "part", "n_tokens"))
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(df, folder, PATH)
    rows = sorted(token_store.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    given = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(repr((r.doc_id, r.ids)) for r in rows) == sorted(
        repr((i, ids + [2])) for (i, _), ids in zip(given, library([t for _, t in given]))
    )
    assert [r.doc_id for r in rows] == sorted((i for i, _ in given), key=lambda i: (i is not None, i))
    ends = np.cumsum([len(r.ids) for r in rows]).tolist()
    assert [r.start for r in rows] == [0, *ends[:-1]]
    some = token_store.read_tokens(spark, folder, 3, 5).collect()
    assert sorted(r.doc_id for r in some) == [3, 4, 5]
    assert {r.doc_id: r.start for r in some}.items() <= {r.doc_id: r.start for r in rows}.items()
    numbers = token_store.read_numbers(spark, folder)
    assert numbers.columns == ["doc_id", "start", "n_tokens"]
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def test_encodings_and_page_index(spark):
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), folder, PATH)
    for file in glob.glob(folder.removeprefix("file:") + "/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["offset"].encodings
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if not n.startswith("ids"))


def test_empty_table(spark):
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(documents(spark, texts=[]), folder, PATH)
    assert token_store.read_tokens(spark, folder).count() == 0


def test_query(spark):
    start, expected = 0, []
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for (doc_id, _), ids in zip(docs, library([t for _, t in docs])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        expected.append((doc_id, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    assert sorted(map(tuple, QUERIES["op5_token_store"](spark, SF).collect())) == expected
