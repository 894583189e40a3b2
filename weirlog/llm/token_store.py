"""Token ids of documents in Parquet files that can be read in part.

A store is a folder of Parquet files in ascending id order. A row holds a
document: ``part`` (the file's place in the order), ``doc_id``, ``offset`` (ids of
the documents before it in its part), ``n_tokens`` and ``ids``. The ids, which
are below the vocabulary's size and repeat, are dictionary encoded; the ascending
numbers are delta encoded. Row groups and pages are small enough that a reader
which wants a few documents, or the numbers only, skips the rest by the
statistics in the page index.

The texts are ordered by one range shuffle and encoded behind it, so neither the
ids are shuffled nor is a text encoded twice.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
BYTES_AT_ONCE = 4 << 20  # of texts, or a single text
REMEMBERED = 300_000  # pieces of text whose ids a worker keeps

# Texts of these characters alone are cut here by the byte-level tokenizer's own rule,
# and each distinct piece is given to the library once. Letters and numbers of
# later Unicode blocks differ between versions: other texts go to the library whole.
_LETTER = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]")
_NUMBER = re.compile("[0-9²³¹¼-¾]")
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_BLANK, _WHITE, _OTHER = 0, 1, 4  # classes of characters; letters are 2, numbers 3


def _class(char: str) -> int:
    if char in " \t\n\r":
        return _BLANK if char == " " else _WHITE
    return 2 if _LETTER.match(char) else 3 if _NUMBER.match(char) else _OTHER


_CLASSES = bytes([_class(chr(i)) for i in range(128)] + [_OTHER] * 128)
_LEAD = 0xC2  # of the first character of two bytes; the bytes that follow a lead are smaller
_WIDE = np.array([_class(chr(i)) for i in range(0x80, 0x250)], np.uint8)
_WITHIN, _CUT, _MAYBE = 0, 1, 2
# The characters that stand for bytes in byte-level vocabularies: printable ones for themselves.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLED = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(_PLAIN))) if b}
# By the classes of a character and the one before it. A blank goes with what follows
# it; of white space before other text the last character stands by itself.
_RULE = bytes(
    _MAYBE if before <= _WHITE and c <= _WHITE else _WITHIN if before in (c, _BLANK) else _CUT
    for before in range(5)
    for c in range(5)
).ljust(256)


def _cuts(joined: bytes, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of simple texts start in their joined bytes; ``starts`` are those of the texts."""
    n, data = len(joined), np.frombuffer(joined, np.uint8)
    # Tables of bytes are applied as such: an index array would take eight times the memory.
    classes = np.frombuffer(bytearray(joined.translate(_CLASSES)), np.uint8)
    leads = np.flatnonzero(data >= _LEAD)
    classes[leads] = classes[leads + 1] = _WIDE[(data[leads] - _LEAD) * np.intp(64) + data[leads + 1] - 0x80]
    # Two bytes of padding, which belong to no text.
    first = np.zeros(n + 2, bool)
    first[starts] = True
    first[n:] = True
    pairs = classes[:-1] * np.uint8(5)
    pairs += classes[1:]
    rule = np.frombuffer(pairs.tobytes().translate(_RULE), np.uint8)
    cut = first[: n + 1].copy()
    cut[1:n] |= rule == _CUT
    white = np.flatnonzero(rule == _MAYBE) + 1
    white = white[~first[white + 1]]
    cut[white[classes[white + 1] > _WHITE]] = True
    # 's, 't, 'm, 'd, 're, 've and 'll, where no blank and no other such character stands before.
    quotes = np.flatnonzero(data == ord("'"))
    before = classes[quotes - 1]
    quotes = quotes[(first[quotes] | ((before != _BLANK) & (before != _OTHER))) & ~first[quotes + 1]]
    one = data[quotes + 1]
    two = np.where(first[quotes + 2], 0, data[np.minimum(quotes + 2, n - 1)])
    short = np.isin(one, list(b"stmd"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    cut[quotes[short | long] + 1] = False
    cut[quotes[short] + 2] = True
    cut[quotes[long] + 3] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """One tokenizer file of the tokenizers library, with the ids of pieces seen before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The cutting rule is that of a byte-level tokenizer without normalizer or prefix space.
        cutter = self.library.pre_tokenizer
        self.cuts = (
            type(cutter).__name__ == "ByteLevel"
            and not cutter.add_prefix_space
            and cutter.use_regex
            and self.library.normalizer is None
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in found]

    def _simple(self, text: str) -> bool:
        return self.cuts and _SIMPLE.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces. The library's model takes a piece in the characters that stand for its bytes; no simple text holds a zero."""
        spelled = "\0".join(pieces).encode().decode("latin-1").translate(_SPELLED).split("\0")
        tokenize = self.library.model.tokenize
        found = [array("i", [t.id for t in tokenize(s)]).tobytes() for s in spelled]
        # What is met first is what is met most; the pieces met last are mostly rare.
        self.known.update(islice(zip(pieces, found), max(0, REMEMBERED - len(self.known))))
        return found

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of simple texts: each distinct piece is looked up once, and its ids are put in all its places."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        del raw
        if not data:
            return [np.zeros(0, "<i4") for _ in texts]
        at = _cuts(data, ends[:-1][ends[:-1] < ends[1:]])
        offsets = np.append(at, len(data))
        every = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        pieces = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, pieces))
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if new:
            learnt = iter(self._learn(new))
            found = [next(learnt) if ids is None else ids for ids in found]
        stops = np.cumsum([0, *map(len, found)]) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(b"".join(found), "<i4")))
        placed = lists.take(every.indices)
        ids, bounds = placed.values.to_numpy(), placed.offsets.to_numpy()[np.searchsorted(at, ends)]
        return [ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens."""
        simple = [self._simple(t) for t in texts]
        cut = iter(self._pieces([t for t, s in zip(texts, simple) if s]))
        whole = iter(self._whole([t for t, s in zip(texts, simple) if not s]))
        return [next(cut) if s else np.frombuffer(next(whole), "<i4") for s in simple]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def write_tokens(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every text and write the store to ``folder``.

    ``tokenizer`` is the path of a tokenizers file that all executors can read.
    The end id follows every document. A null or empty text is the end id
    alone. A null id comes first; rows that share an id are ordered by a hash
    of their text, and equal rows are written as often as they occur. An empty
    table gives an empty store. Other columns are not written.
    """
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    docs = df.select(quoted(id_column).alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    # The tie in the key spreads an id that very many rows share.
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // BYTES_AT_ONCE
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                piece = batch.slice(at, end - at)
                ids = [np.append(x, np.int32(end_id)) for x in encode(piece.column(1).to_pylist())]
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), piece.column(0), pa.array(offsets), pa.array(counts), _lists(ids)],
                    ["part", "doc_id", "offset", "n_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = ordered.mapInArrow(run, f"part int, doc_id {kind}, offset bigint, n_tokens bigint, ids array<int>")
    (
        rows.write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(folder)
    )


def read_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``n_tokens``; reads no ids."""
    return read_tokens(spark, folder).drop("ids")


def read_tokens(spark: SparkSession, folder: str, first_id=None, last_id=None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids``, of all documents or of a range of ids."""
    rows = spark.read.parquet(folder)
    # One row per file, whatever the number of documents.
    sizes = sorted(map(tuple, rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens"))).collect()))
    before, bases = 0, []
    for part, size in sizes:
        bases.append((part, before))
        before += size
    base = F.from_json(F.lit(str([list(b) for b in bases])), "array<array<bigint>>")
    starts = F.map_from_entries(F.transform(base, lambda b: F.struct(b[0].cast("int"), b[1])))
    files = spark.range(1).select(F.explode(starts).alias("part", "base"))
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def ids_crc32(ids):
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("bigint")
    def run(lists: pa.Array) -> pa.Array:
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])], pa.int64())

    return run(ids)
