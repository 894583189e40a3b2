"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item is a set of word shingles. Items are partitioned by the size of that
set, in powers of two, and an item's sketch is its smallest shingle hashes: as
many as an item of its partition can miss at the threshold, plus one. A document
that contains enough of an item therefore holds at least one hash of the sketch;
nothing is missed. (A signature of a whole long document would not do: the item
is a thousandth of it and hardly ever supplies a minimum.)

The documents' shingle hashes are joined to the sketches, as a broadcast if these
are counted to be small, else by shuffle. Candidates are verified by the words
themselves. No text is shuffled while the candidates are few; a count decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.llm.rows import pack, quoted, unpack
from weirlog.llm.words import gram_hashes, words
from weirlog.session import Scratch

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000


def sketch_size(shingles: int, threshold: float) -> int:
    """Hashes to keep of an item, by the largest size in its partition."""
    largest = (1 << shingles.bit_length()) - 1
    return max(n - math.ceil(threshold * n) + 1 for n in range(shingles, largest + 1))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.large_binary())]


def sketches(text: Column, threshold: float) -> Column:
    """The sketch of an item; one of fewer words than a shingle is a shingle of its own."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in _texts(texts):
            found = words(text)
            hashes = np.unique(gram_hashes(found, min(SHINGLE, max(1, len(found)))).view(np.uint64))
            out.append(hashes[: sketch_size(len(hashes), threshold)].view(np.int64) if len(hashes) else hashes.view(np.int64))
        return _lists(out)

    return run(text)


def shingles(text: Column, lengths: list[int]) -> Column:
    """The distinct shingle hashes of a document, for each length of shingle asked for."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in _texts(texts):
            found = words(text)
            out.append(np.unique(np.concatenate([gram_hashes(found, n) for n in lengths])))
        return _lists(out)

    return run(text)


def item_shingles(text: bytes) -> set[bytes]:
    found = words(text)
    n = min(SHINGLE, len(found))
    return {b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def _shared(document: Column, items: Column) -> Column:
    """For each item's text the numbers of its shingles and of those the document contains."""

    @F.arrow_udf("array<struct<shingles: int, shared: int>>")
    def run(documents: pa.Array, items: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("shingles", pa.int32()), ("shared", pa.int32())]))
        out = []
        for document, wanted in zip(_texts(documents), items.to_pylist()):
            line = b" " + b" ".join(words(document)) + b" "
            row = []
            for text in wanted:
                all_ = item_shingles(text.encode())
                row.append({"shingles": len(all_), "shared": sum(b" " + s + b" " in line for s in all_)})
            out.append(row)
        return pa.array(out, kind)

    return run(document, items)


def find_items(
    df: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Every document and item of whose shingles the document contains ``threshold`` or more.

    Columns: ``doc_id``, ``version`` (a hash of the text), ``item_id``, ``shingles``,
    ``shared``, ``containment``. Shingles are sets of five lower-cased words; an
    item of fewer words is one shingle, found where its words stand together.
    Items and documents without words (null, empty, punctuation) match nothing.
    Rows that agree in id and text count once, in both tables. Other columns
    are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    item_text = quoted(item_text_column).cast("string")
    wanted = items.select(quoted(item_id_column).alias("item_id"), item_text.alias("item")).distinct()
    wanted = scratch.table(wanted.withColumn("sketch", sketches(F.col("item"), threshold)).where("size(sketch) > 0"), "items")
    sketch = wanted.select("item_id", "item", F.explode("sketch").alias("hash"))
    # Sizes below a full shingle that occur: each is a partition of its own.
    size = F.size(F.regexp_extract_all(F.col("item"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    lengths = sorted(r[0] for r in wanted.select(F.least(size, F.lit(SHINGLE)).alias("n")).distinct().collect())
    small = sketch.count() <= BROADCAST_ROWS
    text = quoted(text_column).cast("string")
    docs = df.select(quoted(id_column).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    hashed = docs.select("doc_id", "version", F.explode(shingles(F.col("text"), lengths or [SHINGLE])).alias("hash"))
    keys = F.broadcast(sketch) if small else sketch
    candidates = hashed.join(keys, "hash").select("doc_id", "version", "item_id", "item").distinct()
    candidates = scratch.table(candidates, "candidates")
    few = candidates.count() <= BROADCAST_ROWS
    per_document = candidates.groupBy(F.col("doc_id").alias("found_id"), F.col("version").alias("found_version")).agg(
        F.collect_list(F.struct("item_id", "item")).alias("items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version"))
    rows = docs.join(F.broadcast(per_document) if few else per_document, same)
    counts = _shared(F.col("text"), F.col("items.item"))
    rows = rows.select("doc_id", "version", F.explode(F.arrays_zip(F.col("items"), counts.alias("n"))).alias("r"))
    return (
        rows.select("doc_id", "version", F.col("r.items.item_id").alias("item_id"), "r.n.shingles", "r.n.shared")
        .withColumn("containment", F.round(F.col("shared") / F.col("shingles"), 6))
        .where(F.col("shared") >= threshold * F.col("shingles"))
        .withColumns({c: F.col(c).cast("bigint") for c in ("shingles", "shared")})
        .distinct()
    )


def without_items(
    df: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``df`` that contain no item, with their own columns only."""
    scratch = Scratch(df.sparkSession)
    found = find_items(df, items, threshold, id_column, text_column).select(
        F.col("doc_id").alias("found_id"), F.col("version").alias("found_version")
    )
    found = scratch.table(found.distinct(), "contaminated")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = pack(df, doc_id=quoted(id_column), version=F.xxhash64(quoted(text_column).cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version"))
    return unpack(rows.join(found, same, "left_anti"), df.columns)
