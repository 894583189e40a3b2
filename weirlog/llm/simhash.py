"""Near-duplicate texts by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within three bits meet in the middle: one bit away from each
of them there are two values that are equal or one bit apart. And in one half of
the 64 bits they differ in one bit at most. So every distinct fingerprint emits, for
each half, that half as it is and with each single bit flipped (66 variants),
and the variants are shuffled on their value. Where fingerprints meet, the
other half's flips are made on the spot, and values that are equal or one bit
apart link their owners. No value lists the pairs that meet there: each run of
equal values links to its first, and each value looks for its 32 neighbours, so
the work is linear in the variants however many copies come together. The links
of a batch are reduced to stars before they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.llm.components import components, forest
from weirlog.llm.rows import pack, quoted, unpack
from weirlog.session import Scratch

SEED = 42
RADIUS = 3  # the halves and their single flips are made for this one
LOCAL_VALUES = 1 << 21  # flipped values a task holds at once, unless one key has more


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a shorter text is one shingle."""
    line = b" ".join(text.lower().split())
    if not line:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(line)][words - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends)], np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The signed 64-bit SimHash: bit i is set if it is in over half of the hashes."""
    hashes = shingle_hashes(text or b"", words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in bounded pieces
        piece = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), words) for t in texts.cast(pa.large_binary())], pa.int64())

    return run(text.cast("string"))


def variants(fps: DataFrame) -> DataFrame:
    """66 rows per fingerprint: ``side``, ``value`` (the variant half above, the other half below), ``flip``."""
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    sides = F.array(
        F.struct(F.lit(0).cast("tinyint").alias("side"), F.col("fp").alias("value")),
        F.struct(F.lit(1).cast("tinyint").alias("side"), turned.alias("value")),
    )
    flips = F.from_json(F.lit(str([-1, *range(32, 64)])), "array<int>")
    flipped = F.when(F.col("flip") < 0, F.col("value")).otherwise(
        F.col("value").bitwiseXOR(F.expr("shiftleft(1L, flip)"))
    )
    return (
        fps.select(F.explode(sides).alias("s"))
        .select("s.side", "s.value", F.explode(flips).alias("flip"))
        .select("side", flipped.alias("value"), F.col("flip").cast("tinyint").alias("flip"))
    )


def _owners(value: np.ndarray, flip: np.ndarray) -> np.ndarray:
    bit = np.left_shift(np.int64(1), np.maximum(flip, 0).astype(np.int64))
    return np.where(flip >= 0, value ^ bit, value)


def linked(value: np.ndarray, flip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the owners of sorted values of whole keys (their upper halves)."""
    owner = _owners(value, flip)
    key = value >> 32
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    met = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    keep = np.repeat(met, sizes)
    value, owner, plain = value[keep], owner[keep], flip[keep] < 0
    if not len(value):
        return value, value
    # One flip in all: the other half's are made of unflipped values only.
    bits = np.left_shift(np.int64(1), np.arange(32, dtype=np.int64))
    near = (value[plain][:, None] ^ bits).ravel()
    value = np.concatenate([value, near])
    owner = np.concatenate([owner, np.repeat(owner[plain], 32)])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    head = np.flatnonzero(first)
    a, b = [owner], [owner[head[np.cumsum(first) - 1]]]
    heads, owners = value[head], owner[head]
    for bit in bits:
        from_ = np.flatnonzero((heads & bit) == 0)
        to = np.searchsorted(heads, heads[from_] | bit)
        hit = to < len(heads)
        hit[hit] = heads[to[hit]] == (heads[from_[hit]] | bit)
        a.append(owners[from_[hit]])
        b.append(owners[to[hit]])
    a, b = np.concatenate(a), np.concatenate(b)
    real = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS)
    return a[real], b[real]


def _turned(fp: np.ndarray) -> np.ndarray:
    bits = fp.view(np.uint64)
    return ((bits << np.uint64(32)) | (bits >> np.uint64(32))).view(np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by side and value, cut at key boundaries, each cut linked by itself."""

    def done(side: int, value: np.ndarray, flip: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(value):
            return
        a, b = linked(value, flip)
        if len(a):
            node, root = forest(*((_turned(a), _turned(b)) if side else (a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])

    held_side, held = 0, (np.zeros(0, np.int64), np.zeros(0, np.int8))
    for batch in batches:
        sides, values, flips = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for side in (0, 1):
            here = sides == side
            if not here.any():
                continue
            if side != held_side:
                yield from done(held_side, *held)
                held_side, held = side, (np.zeros(0, np.int64), np.zeros(0, np.int8))
            held = np.concatenate([held[0], values[here]]), np.concatenate([held[1], flips[here]])
            if len(held[0]) >= LOCAL_VALUES // 33:
                key = held[0] >> 32
                cut = int(np.searchsorted(key, key[-1]))
                yield from done(side, held[0][:cut], held[1][:cut])
                held = held[0][cut:], held[1][cut:]
    yield from done(held_side, *held)


def links(fps: DataFrame) -> DataFrame:
    """Links that join all fingerprints within three bits (``u``, ``v``), as stars of batches."""
    emitted = variants(fps)
    key = F.shiftright("value", 32)
    return (
        emitted.repartition("side", key)
        .sortWithinPartitions("side", "value")
        .mapInArrow(_link_batches, "u bigint, v bigint")
    )


def named(
    hashed: DataFrame, links: DataFrame, scratch: Scratch, distinct: DataFrame | None = None
) -> DataFrame:
    """The rows ``doc_id``, ``version``, ``fp`` with the components that links between fingerprints make."""
    if distinct is None:
        distinct = scratch.table(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = scratch.table(rooted, "rooted")
    names = scratch.table(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    named = scratch.table(rooted.join(names, "root").select("fp", "component_id"), "named")
    return hashed.join(named, "fp").select(
        "doc_id", "version", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3
) -> DataFrame:
    """A row ``doc_id``, ``version`` (hash of the text), ``fingerprint``, ``component_id`` for every row.

    Fingerprints (16 hex digits) that differ in three bits or fewer are linked,
    also those of texts without words (null, empty, blanks), which are zero.
    The component is named by the smallest id it reaches, null if it has none.
    Equal rows are in one component. Other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    text = quoted(text_column)
    docs = df.select(
        quoted(id_column).alias("doc_id"), F.xxhash64(text).alias("version"), fingerprints(text, words).alias("fp")
    )
    hashed = scratch.table(docs, "fingerprints")
    distinct = scratch.table(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    return named(hashed, links(distinct), scratch, distinct)


def keep_one_of_each(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of each component stays.

    It is the row with the smallest id, and of rows with that id the one whose
    text hashes lowest. A component without any id keeps one row too. No
    column is added.
    """
    found = near_duplicates(df, id_column, text_column, words)
    kept = found.groupBy(
        F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("nameless"), "component_id"
    ).agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("version"))).alias("version"))
    kept = kept.select(F.col("component_id").alias("keep_id"), F.col("version").alias("keep_version")).distinct()
    rows = pack(df, doc_id=quoted(id_column), version=F.xxhash64(quoted(text_column)))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("version") == F.col("keep_version"))
    chosen = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "version"])
    return unpack(chosen, df.columns)
