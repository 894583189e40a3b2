"""Collocations: phrases of two to four words that cut badly, counted from their longest windows.

Every word of a text starts one window: itself and the three words behind it in
its piece, padded where the piece ends. Only these longest windows are counted;
a ROLLUP over their words sums the counts of successively shorter prefixes, which
are the counts of all shorter phrases, since each occurrence of a phrase is the
prefix of the window that starts where it does.

Before that, words are counted once per language. A phrase is at most as frequent
as its rarest word, so a word that is rarer than the threshold ends a window like
the end of a piece does. Frequent words travel as numbers: the most frequent ones,
as many as a dictionary of fixed size holds, have their place in it, and any
others a 62-bit hash, which is tried with other seeds until no two words of the
table share one. The first kind makes narrow rows, the second needs no broadcast.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted
from weirlog.session import Scratch

LONGEST = 4
WORDS = ["w1", "w2", "w3", "w4"]
UNKNOWN = "und"
DICTIONARY = 1_000_000  # words that are sent to all tasks
COUNTED_AT_ONCE = 500_000  # distinct words a task holds
WINDOWS_AT_ONCE = 1 << 18
HASHED = 1 << 62  # the numbers of words outside the dictionary start here
SALTS = 64
PARTS = 1_000_000  # a score of one

_BREAK = b"\n"
# A-Z in lower case, a tab as a blank, what ends a piece as a line end.
_TABLE = bytes.maketrans(
    (string.ascii_uppercase + "\t" + ".,;:!?\x0a\x0b\x0c\x0d").encode(),
    (string.ascii_lowercase + " " + "\n" * 10).encode(),
)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with a line end where a piece ends."""
    # What split() takes for blanks is a blank or a line end by now.
    return text.translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items() if word not in (b"", _BREAK)]
        counts.clear()
        langs, words, ns = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array(ns, pa.int64())],
            ["lang", "word", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[lang].update(tokens(text))
            if sum(map(len, counts.values())) > COUNTED_AT_ONCE:
                yield flush()
    yield flush()


def _hashed(lang: Column, word: Column, seed: int) -> Column:
    """The number of a word outside the dictionary, as ``_Numbers`` makes it."""
    h = F.xxhash64(F.concat(lang, F.lit(" "), word, F.lit(f" {seed}")))
    return F.shiftrightunsigned(h, 2).bitwiseOR(F.lit(HASHED))


class _Numbers(dict):
    """Words of one language to numbers; 0 for the end of a piece and for words too rare to matter."""

    def __init__(self, lang: str, known: tuple[bytes, np.ndarray] | None, seed: int | None):
        if known is not None:
            words, numbers = known
            super().__init__(zip(words.split(_BREAK), numbers.tolist()))
        self.update({b"": -1, _BREAK: 0})
        self.lang, self.seed = lang.encode(), seed

    def __missing__(self, word: bytes) -> int:
        if self.seed is None:
            return 0
        return xxhash.xxh64_intdigest(b"%s %s %d" % (self.lang, word, self.seed), 42) >> 2 | HASHED


def windows(numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct padded windows of a sequence and their counts, in order; 0 parts the sequence."""
    padded = np.concatenate([numbers, np.zeros(LONGEST - 1, np.int64)])
    columns = [numbers]
    for i in range(1, LONGEST):
        columns.append(np.where(columns[-1] == 0, 0, padded[i : i + len(numbers)]))
    started = numbers != 0
    columns = [c[started] for c in columns]
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if max(c.max() for c in columns) < 1 << 31:  # two words fit in one number
        keys = [columns[0] << 32 | columns[1], columns[2] << 32 | columns[3]]
    else:
        keys = columns
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    starts = np.flatnonzero(new)
    return [c[order[starts]] for c in columns], np.diff(np.append(starts, len(order)))


def _count_windows(dictionary, seed: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        held: list[np.ndarray] = []
        size = 0
        end = np.zeros(1, np.int64)

        def flush() -> pa.RecordBatch:
            columns, n = windows(np.concatenate([end, *held]))
            held.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], [*WORDS, "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in numbers:
                    numbers[lang] = _Numbers(lang, dictionary.value.get(lang), seed)
                found = tokens(text)
                coded = np.fromiter(map(numbers[lang].__getitem__, found), np.int64, len(found))
                held += [coded[coded >= 0], end]  # -1 stands for the empty pieces between blanks
                size += len(found)
                if size > WINDOWS_AT_ONCE:
                    yield flush()
                    size = 0
        yield flush()

    return run


def _seed(words: DataFrame, known: Column) -> int:
    """A seed that gives all words outside the dictionary different numbers."""
    for seed in count():
        hashed = words.where(~known).select(_hashed(F.col("lang"), F.col("word"), seed).alias("number"))
        if hashed.groupBy("number").count().where("count > 1").isEmpty():
            return seed


def _numbered(words: DataFrame, least: int, room: int, scratch: Scratch):
    """The frequent words with their numbers, the dictionary, and the seed of the others (None: all are in it)."""
    steps = [least << i for i in range(60 - least.bit_length())]
    over = words.agg(*[F.count_if(F.col("n") >= s).alias(str(s)) for s in steps]).first()
    floor = next((s for s in steps if over[str(s)] <= room), steps[-1])
    known = F.col("n") >= floor
    seed = None if floor == least else _seed(words, known)
    # At most ``room`` rows.
    top = words.where(known).orderBy(F.desc("n"), "lang", "word").select("lang", "word", "n").toArrow()
    top = top.append_column("number", pa.array(np.arange(1, top.num_rows + 1)))
    # Packed per language; each worker makes its own dictionary of it.
    dictionary: dict[str, tuple[bytes, np.ndarray]] = {}
    for lang in top["lang"].unique().to_pylist():
        mine = top.filter(pc.equal(top["lang"], lang))
        dictionary[lang] = ("\n".join(mine["word"].to_pylist()).encode(), mine["number"].to_numpy())
    schema = "lang string, word string, n bigint, number bigint"
    frequent = words.sparkSession.createDataFrame(top, schema) if top.num_rows else None
    if seed is not None:
        rest = words.where((F.col("n") >= least) & ~known)
        rest = rest.select("lang", "word", "n", _hashed(F.col("lang"), F.col("word"), seed).alias("number"))
        frequent = rest if frequent is None else frequent.unionByName(rest)
    if frequent is None:
        frequent = words.sparkSession.createDataFrame([], schema)
    return scratch.table(frequent, "frequent-words"), dictionary, seed


def _phrase_counts(counted: DataFrame, least: int) -> DataFrame:
    """How often each phrase of up to four words occurs, ``w1`` to ``w4`` padded with 0 and ``f``; frequent ones."""
    shorter = counted.rollup("w1", "w2", "w3").agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # What is left out is null; a padded last word makes no phrase of its own.
    last = F.when(F.col("left_out") == 0, F.col("w3")).when(F.col("left_out") == 1, F.col("w2")).otherwise(F.col("w1"))
    shorter = shorter.where((F.col("f") >= least) & (F.col("left_out") < 7) & (last != 0))
    filled = shorter.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in WORDS[:3]], F.lit(0).cast("bigint").alias("w4"), "f")
    longest = counted.where((F.col("n") >= least) & (F.col("w4") != 0)).select(*WORDS, F.col("n").alias("f"))
    return filled.unionByName(longest)


def _padded(words: list[Column]) -> list[Column]:
    return [*words, *[F.lit(0).cast("bigint")] * (LONGEST - len(words))]


def _parts(i: int, j: int, names: list[str]) -> list[Column]:
    """Words i to j (exclusive) of a phrase as a phrase of its own."""
    return [w.alias(n) for w, n in zip(_padded([F.col(c) for c in WORDS[i:j]]), names)]


def _length() -> Column:
    return F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Each candidate with the counts of the two parts of its worst cut, and its score."""
    first, rest = [f"a{w}" for w in WORDS], [f"b{w}" for w in WORDS]
    cuts = [
        candidates.where(_length() == size).select(
            *WORDS, "a", F.lit(k).alias("k"), *_parts(0, k, first), *_parts(k, size, rest)
        )
        for size in range(2, LONGEST + 1)
        for k in range(1, size)
    ]
    every = cuts[0]
    for cut in cuts[1:]:
        every = every.unionByName(cut)
    left = counts.select(*[F.col(w).alias(n) for w, n in zip(WORDS, first)], F.col("f").alias("l"))
    right = counts.select(*[F.col(w).alias(n) for w, n in zip(WORDS, rest)], F.col("f").alias("r"))
    every = every.join(left, first).join(right, rest)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    every = every.withColumn("top", (F.lit(2 * PARTS).cast("decimal(7,0)") * wide("a")).cast("decimal(27,0)"))
    every = every.withColumn("score", F.expr("top div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    return every.groupBy(*WORDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))


def _contained(candidates: DataFrame) -> DataFrame:
    """Phrases inside longer candidates, with the count of the most frequent of those."""
    inside = [
        candidates.where(_length() == size).select(*_parts(i, i + inner, WORDS), F.col("a").alias("longer"))
        for size in range(3, LONGEST + 1)
        for inner in range(2, size)
        for i in range(size - inner + 1)
    ]
    every = inside[0]
    for part in inside[1:]:
        every = every.unionByName(part)
    return every.groupBy(*WORDS).agg(F.max("longer").alias("longer"))


def collocations(
    df: DataFrame,
    least: int = 30,
    covered: int = 80,
    best: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
    dictionary: int = DICTIONARY,
) -> DataFrame:
    """Each language's ``best`` phrases of two to four words by ``score``.

    A-Z is lower-cased, a text ends a piece at ``. , ; : ! ?`` and at line
    ends, and its words are parted by blanks and tabs. Candidates occur ``least``
    (at least 1) times or more inside pieces. Result: ``lang``, ``rank`` from 1, ``phrase``,
    ``a`` (its count), ``l`` and ``r`` (those of the parts of its lowest-scoring cut), ``n``
    (all words of the language) and ``score``, floor(2000000 a / (l + r)). Candidates
    inside a longer one with ``covered`` percent of their count go. Ties go to the greater count,
    then to the smaller phrase by its bytes. A null language is ``und``, a
    null text empty. Rows that repeat count as often as they occur. Texts
    without words, and an empty table, give nothing. ``dictionary`` bounds the words sent to all tasks; the
    result does not depend on it. Other columns are not looked at.
    """
    spark = df.sparkSession
    text = F.coalesce(quoted(text_column).cast("string"), F.lit("")).cast("binary")
    docs = df.select(F.coalesce(quoted(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"))
    found = Scratch(spark)  # what the result reads
    with Scratch(spark) as scratch:
        words = docs.mapInArrow(_count_words, "lang string, word string, n bigint")
        words = scratch.table(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        frequent, known, seed = _numbered(words, least, dictionary, scratch)
        sent = spark.sparkContext.broadcast(known)
        counted = docs.mapInArrow(_count_windows(sent, seed), ", ".join(f"{c} bigint" for c in [*WORDS, "n"]))
        # In order, so that prefixes stand together where the ROLLUP adds them up, and pack well.
        counted = counted.groupBy(*WORDS).agg(F.sum("n").alias("n")).sortWithinPartitions(*WORDS)
        counted = scratch.table(counted, "windows")
        counts = scratch.table(_phrase_counts(counted, least), "phrase-counts")
        sent.unpersist()
        candidates = counts.where("w2 != 0").withColumnRenamed("f", "a")
        kept = _scored(candidates, counts).join(_contained(candidates), WORDS, "left")
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        kept = kept.where(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
        for w in WORDS:
            name = frequent.select(F.col("number").alias(w), F.struct("lang", "word").alias(f"{w}_name"))
            kept = kept.join(name, w, "inner" if w in ("w1", "w2") else "left")
        phrase = F.concat_ws(" ", *[F.col(f"{w}_name.word") for w in WORDS])
        rows = kept.select(F.col("w1_name.lang").alias("lang"), phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        # The best of a language are among the best of its shares, so no task sorts a whole language.
        share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        by_share = Window.partitionBy("lang", "share").orderBy(*order)
        rows = rows.withColumn("share", share).withColumn("rank", F.row_number().over(by_share))
        rows = rows.where(F.col("rank") <= best).drop("share")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
        rows = rows.where(F.col("rank") <= best).join(totals, "lang")
        columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        numbers = [F.col(c).cast("bigint") for c in ("rank", "a", "l", "r", "n", "score")]
        rows = rows.withColumns(dict(zip(("rank", "a", "l", "r", "n", "score"), numbers))).select(columns)
        return found.table(rows, "collocations")
