"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model is trained on all trusted texts but a held-out fifth, chosen by a hash
of the text so that copies fall on one side. Counts are aggregates, combined
before their shuffle. All bigrams and all continuations are kept.

A document costs what its words cost by the lower order; each pair of the model
knows what it saves. The most frequent words and pairs, a bounded number of them,
are sent to all tasks, which look them up and sum a document's tokens where it is read;
all others stay sharded by key. A filter (a blocked Bloom
filter) of the rare words and pairs is sent too and decides which tokens can
be one of them at all, and only those are shuffled. The filter is bounded; where
a model is too large for it, all tokens that are not frequent are shuffled, with the
same result. Documents take turns, so that only a part of these tokens is on disk at once.
Log probabilities are summed as integers, so that a result does not depend
on the order of the sum.

A document is rejected if its score is high above those of held-out trusted
documents of its language: above their 99th percentile by more than half the
way from the median to it. Scores of short documents are drawn to the median.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.hashes import murmur, xxhash64
from weirlog.llm.rows import pack, quoted, unpack
from weirlog.session import Scratch, remove_folder

WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
EDGE = 0  # stands for the start and the end of a text
MICRO = 1_000_000
CUTOFF = 1  # bigrams seen less often are left to the lower order: none
BROADCAST_ROWS = 1_000_000  # in all, of some 80 bytes as a hash table
WORDS_SHARE, PAIRS_SHARE = 0.3, 0.15  # of these rows; the rest are filter blocks
LANES = 4  # 64-bit words of a filter block; a key sets one bit in each
KEYS_A_BLOCK = 32
USELESS = 128  # keys a block at which the filter lets over half of all tokens pass
ROUNDS = 6  # parts of the documents whose tokens are shuffled one after the other
ROUND_ROWS = 10_000  # fewer documents are not parted
HASHED_ROWS = 1_000_000  # rare keys of a task that are held as a hash table; more are sorted
AT_ONCE = 250_000  # tokens looked up at once
LEVELS = [1, 2, 3, 4, 6, 8, *(1 << i for i in range(4, 40))]  # counts that may part frequent from rare
BIN = 1000  # score bins per nat
DRAWN = 20  # tokens of median score that every document is given
QUANTILE = 0.99
FENCE = 0.5
HELD_OUT = 5  # one in so many trusted texts
ENOUGH = 50  # held-out documents that a language needs to have a stricter limit than all together

POOLED = "*"


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """Hashes of the words of each text, in order, as the array ``hashes``."""
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))


def _pairs(docs: DataFrame, *keep: str) -> DataFrame:
    """Hashes ``v``, ``w`` of each two neighbouring words, the text's edges included."""
    # A column of its own, or a text is cut into words once for ``v`` and once for ``w``.
    hashed = _words(docs, *keep)
    edge = F.array(F.lit(EDGE).cast("bigint"))
    zipped = F.arrays_zip(F.concat(edge, F.col("hashes")).alias("v"), F.concat(F.col("hashes"), edge).alias("w"))
    return hashed.select(*keep, F.explode(zipped).alias("p")).select(*keep, "p.v", "p.w")


def _discounts(counts: DataFrame, column: str) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    row = counts.agg(*[F.count_if(F.col(column) == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = (
        1 - 2 * y * n2 / n1 if n1 else 0.5,
        2 - 3 * y * n3 / n2 if n2 else 1.0,
        3 - 4 * y * n4 / n3 if n3 else 1.5,
    )
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]


def _discounted(count: Column, d: list[float]) -> Column:
    return count - F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def micro(share: Column) -> Column:
    return F.rint(-F.log(share) * MICRO).cast("bigint")


def _frequent(table: DataFrame, count: str, most: float) -> tuple[int, int, int]:
    """The lowest count that at most ``most`` rows reach, how many reach it, and how many do not."""
    n, at_least = F.col("n"), lambda i: F.when(F.col(count) >= i, F.col("n")).otherwise(0)
    by_count = table.groupBy(count).agg(F.count("*").alias("n"))
    sums = [F.sum(n).alias("n0"), *[F.sum(at_least(i)).alias(f"n{i}") for i in LEVELS]]
    reached = {name: found or 0 for name, found in by_count.agg(*sums).first().asDict().items()}
    level = next((i for i in LEVELS if reached[f"n{i}"] <= most), 1 << 40)
    frequent = reached.get(f"n{level}", 0)
    return level, frequent, reached["n0"] - frequent


class _Lookup:
    """Distinct 64-bit hashes and a number for each: in order, with an index by their highest bits."""

    def __init__(self, rows: DataFrame):
        table = rows.toArrow()
        keys = table.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.values = np.append(table.column(1).to_numpy()[order], 0)
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys[order] >> self.shift, np.arange(1 << bits, dtype=np.uint64))
        # The last one ends every search.
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, and their numbers, 0 for the others."""
        at = self.first[keys >> self.shift]
        later = np.flatnonzero(self.keys[at] < keys)
        while len(later):
            at[later] += 1
            later = later[self.keys[at[later]] < keys[later]]
        there = (self.keys[at] == keys) & (at < len(self.keys) - 1)
        return there, np.where(there, self.values[at], 0)


class _Filter:
    """True for all keys of ``rare`` (``key``, ``part``; ``n`` rows) and few others."""

    def __init__(self, rare: DataFrame, n: int, most: float, parts: int, scratch: Scratch):
        blocks = min(int(most), n // KEYS_A_BLOCK + 1)
        self.parts, self.lanes = parts, None
        if n > blocks * USELESS:
            return
        # Keys that lie in one part of the table share its blocks, so that blocks are made before their shuffle.
        self.each = blocks // parts + 1
        block = F.col("part").cast("bigint") * self.each + F.pmod("key", F.lit(self.each))
        one = F.lit(1).cast("bigint")
        marks = [
            F.call_function("shiftleft", one, F.shiftrightunsigned("key", 40 + 6 * i).bitwiseAND(63).cast("int")).alias(f"lane{i}")
            for i in range(LANES)
        ]
        filled = rare.select(block.alias("block"), *marks).groupBy("block")
        # Written first, so that what was shuffled is gone.
        filled = scratch.table(filled.agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)]), "filter").toArrow()
        remove_folder(rare.sparkSession, scratch.folders.pop())
        self.lanes = np.zeros((self.each * parts, LANES), np.uint64)
        at = filled.column("block").to_numpy()
        for i in range(LANES):
            self.lanes[at, i] = filled.column(f"lane{i}").to_numpy().view(np.uint64)

    def may(self, key: np.ndarray, *hashed: np.ndarray) -> np.ndarray:
        """Keys by their value and by what their part is a hash of."""
        if self.lanes is None:
            return np.ones(len(key), bool)
        part = murmur(*hashed).view(np.int32).astype(np.int64) % self.parts
        filled = self.lanes[part * self.each + key.view(np.int64) % self.each]
        may = np.ones(len(key), bool)
        for i in range(LANES):
            bit = (key >> np.uint64(40 + 6 * i)) & np.uint64(63)
            may &= (filled[:, i] >> bit) & np.uint64(1) != 0
        return may


def _costs(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``doc``, ``key``, ``cost``, ``n_tokens``: one per document, then one without tokens per key to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, rare, unknown = sent.value
        for batch in batches:
            docs, lists = batch.column(0).to_numpy(), batch.column(1)
            hashes, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            # A text has one token more than words: its end.
            upto = offsets.astype(np.int64) - offsets[0] + np.arange(len(offsets))
            i = 0
            while i < len(docs):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1)
                ends = upto[i + 1 : j + 1] - upto[i]
                inner = np.ones(ends[-1], bool)
                inner[ends - 1] = False
                w = np.full(ends[-1], EDGE, np.uint64)
                w[inner] = hashes[offsets[i] : offsets[j]]
                v = np.append(np.uint64(EDGE), w[:-1])
                known, low = words.find(w)
                pair = xxhash64(v, w)
                often, saved = pairs.find(pair)
                cost = np.where(known, low, unknown) + saved
                sizes = np.diff(ends, prepend=0)
                new, less = np.flatnonzero(~known), np.flatnonzero(~often)
                new, less = new[rare.may(w[new], w[new])], less[rare.may(pair[less], v[less], w[less])]
                asked = np.repeat(docs[i:j], sizes)[np.concatenate([new, less])]
                zeros = np.zeros(len(asked), np.int64)
                columns = [
                    np.concatenate([docs[i:j], asked]),
                    np.concatenate([docs[i:j], w[new].view(np.int64), pair[less].view(np.int64)]),
                    np.concatenate([np.add.reduceat(cost, ends - sizes), zeros]),
                    np.concatenate([sizes, zeros]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "key", "cost", "n_tokens"])
                i = j

    return run


class Model:
    """``pairs`` (``pair``, ``part``, ``c``, ``saved``), ``words`` (``word``, ``total``, ``back_off``, ``alone``) and the share of an unknown word."""

    def __init__(self, trusted: DataFrame, scratch: Scratch):
        self.scratch = scratch
        counts = scratch.table(
            _pairs(trusted).groupBy("v", "w").agg(F.count("*").alias("c")).sortWithinPartitions("v"), "pairs"
        )
        spent = scratch.folders[-1:]
        self.after = _discounts(counts, "c")
        taken = F.sum(F.when(F.col("c") >= CUTOFF, _discounted(F.col("c"), self.after)))
        total = F.sum("c")
        back_off = counts.groupBy("v").agg(
            total.alias("total"), (1 - F.coalesce(taken, F.lit(0.0)) / total).alias("back_off")
        )
        # Words count by the number of different words they follow.
        follows = scratch.table(counts.groupBy("w").agg(F.count("*").alias("c")), "follows")
        spent += scratch.folders[-1:]
        single = _discounts(follows, "c")
        shape = follows.agg(F.count("*").alias("words"), F.coalesce(F.sum("c"), F.lit(0)).alias("pairs")).first()
        known = follows.select(
            F.col("w").alias("word"), (_discounted(F.col("c"), single) / F.lit(max(1, shape["pairs"]))).alias("own")
        )
        known = scratch.table(known, "known")
        spent += scratch.folders[-1:]
        self.trained = shape["pairs"] > 0
        left = 1 - (known.agg(F.sum("own")).first()[0] or 0.0)
        self.unknown = left / (shape["words"] + 1)
        words = known.join(back_off.withColumnRenamed("v", "word"), "word", "full").select(
            "word",
            "total",
            F.coalesce("back_off", F.lit(1.0)).alias("back_off"),
            (F.coalesce("own", F.lit(0.0)) + self.unknown).alias("alone"),
        )
        self.words = scratch.table(words.withColumn("total", F.coalesce("total", F.lit(0))), "words")
        for folder in spent[1:]:
            remove_folder(trusted.sparkSession, folder)
        self.parts = int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.often, _, self.n_rare = _frequent(self.words, "total", BROADCAST_ROWS * WORDS_SHARE)
        self.pairs = scratch.table(self._saved(counts), "saved")
        remove_folder(trusted.sparkSession, spent[0])
        scratch.folders = [x for x in scratch.folders if x not in spent]

    def _saved(self, counts: DataFrame) -> DataFrame:
        """What each pair saves; the words of pairs are of no more use then.

        Frequent words come by broadcast; only pairs of a rare word are shuffled,
        by that word, which has few. They return to the part of the shuffle that counted them.
        """
        frequent, rare = self.words.where(F.col("total") >= self.often), self.words.where(F.col("total") < self.often)
        first = [F.col("word").alias("v"), "total", "back_off"]
        second = [F.col("word").alias("w"), "alone"]
        counts = counts.where(F.col("c") >= CUTOFF)
        met = counts.join(F.broadcast(frequent.select(*first)), "v", "left").join(
            F.broadcast(frequent.select(*second)), "w", "left"
        )
        columns = ["v", "w", "c", "total", "back_off", "alone"]
        met = met.select(*columns)
        known = met.where("total is not null and alone is not null")
        by_first = met.where("total is null").drop("total", "back_off").join(rare.select(*first).hint("merge"), "v").select(*columns)
        no_second = met.where("total is not null and alone is null").unionByName(by_first.where("alone is null"))
        by_second = no_second.drop("alone").join(rare.select(*second).hint("merge"), "w").select(*columns)
        shuffled = by_first.where("alone is not null").unionByName(by_second).repartition("v", "w")
        share = _discounted(F.col("c"), self.after) / F.col("total") + F.col("back_off") * F.col("alone")
        return known.unionByName(shuffled).select(
            F.xxhash64("v", "w").alias("pair"),
            F.pmod(F.hash("v", "w"), F.lit(self.parts)).alias("part"),
            "c",
            (micro(share) - micro(F.col("back_off")) - micro(F.col("alone"))).alias("saved"),
        )

    def scores(self, docs: DataFrame, *keep: str) -> DataFrame:
        """Per document (the columns ``keep``) its ``cost`` in micro-nats and ``n_tokens``."""
        spark = docs.sparkSession
        unknown = round(-math.log(self.unknown) * MICRO)
        low = micro(F.col("back_off")) + micro(F.col("alone"))
        lower = self.words.select("word", "total", low.alias("low"))
        level, _, n_pairs = _frequent(self.pairs, "c", BROADCAST_ROWS * PAIRS_SHARE)
        words = _Lookup(lower.where(F.col("total") >= self.often).select("word", "low"))
        pairs = _Lookup(self.pairs.where(F.col("c") >= level).select("pair", "saved"))
        # What is not frequent: what a key adds to the cost of a token that it was not found for.
        part = F.pmod(F.hash("word"), F.lit(self.parts))
        rare_words = lower.where(F.col("total") < self.often).select(F.col("word").alias("key"), part.alias("part"), (F.col("low") - unknown).alias("more"))
        rare_pairs = self.pairs.where(F.col("c") < level).select(F.col("pair").alias("key"), "part", F.col("saved").alias("more"))
        rare, n_rare = rare_words.unionByName(rare_pairs), self.n_rare + n_pairs
        maybe = _Filter(rare.select("key", "part"), n_rare, BROADCAST_ROWS * (1 - WORDS_SHARE - PAIRS_SHARE), self.parts, self.scratch)
        sent = spark.sparkContext.broadcast((words, pairs, maybe, unknown))
        rare = rare.select("key", "more").hint("shuffle_hash" if n_rare <= self.parts * HASHED_ROWS else "merge")

        doc = F.xxhash64(*keep)
        rounds = min(ROUNDS, docs.count() // ROUND_ROWS + 1)
        done = []
        for i in range(rounds):
            # Each round frees what it has shuffled.
            own = docs.select(doc.alias("doc"), "text").where(F.pmod("doc", F.lit(rounds)) == i)
            costs = _words(own, "doc").mapInArrow(_costs(sent), "doc bigint, key bigint, cost bigint, n_tokens bigint")
            if n_rare:
                # A row with tokens is a document's own.
                more = F.when(F.col("n_tokens") == 0, F.coalesce("more", F.lit(0))).otherwise(F.col("cost"))
                costs = costs.join(rare, "key", "left").select("doc", more.alias("cost"), "n_tokens")
            costs = costs.groupBy("doc").agg(F.sum("cost").alias("cost"), F.sum("n_tokens").alias("n_tokens"))
            done.append(self.scratch.table(costs, "costs"))
        sent.destroy()
        costs = done[0]
        for other in done[1:]:
            costs = costs.unionByName(other)
        # Repeated rows are one document; each has brought the same cost and tokens.
        once = docs.groupBy(*keep).agg(F.count("*").alias("copies")).withColumn("doc", doc)
        each = [F.expr(f"{x} div copies").alias(x) for x in ("cost", "n_tokens")]
        return once.join(costs, "doc").select(*keep, *each)


def _quantile(bins: DataFrame, q: float, name: str) -> DataFrame:
    """Per language the lowest bin that holds the quantile, in nats."""
    up = Window.partitionBy("lang").orderBy("bin")
    reached = bins.withColumn("upto", F.sum("n").over(up)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("lang"))
    )
    return reached.where(F.col("upto") >= F.ceil(F.col("total") * q)).groupBy("lang").agg(
        (F.min("bin") / BIN).alias(name), F.max("total").alias("documents")
    )


def _bins(scores: DataFrame, score: Column) -> DataFrame:
    counted = scores.select("lang", F.round(score * BIN).cast("bigint").alias("bin"))
    pooled = counted.select(F.lit(POOLED).alias("lang"), "bin")
    return counted.where("lang is not null").unionByName(pooled).groupBy("lang", "bin").agg(F.count("*").alias("n"))


def judge(
    df: DataFrame,
    trusted_ids: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """A row ``doc_id``, ``version``, ``lang``, ``n_tokens``, ``perplexity``, ``threshold``, ``keep`` per document.

    ``trusted_ids`` has a column ``doc_id``. ``version`` is a hash of the text; rows
    that agree in id, text and language are one document. ``n_tokens`` counts
    the end of the text. Null and empty texts have the median score of their
    language and stay. A language with few held-out trusted documents, or none,
    has at least the limit of all languages together; without any trusted document all stay, with a
    null threshold. Other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    text = quoted(text_column).cast("string")
    docs = df.select(
        quoted(id_column).alias("doc_id"), F.xxhash64(text).alias("version"), quoted(lang_column).alias("lang"), text.alias("text")
    )
    ids = trusted_ids.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = scratch.table(ids, "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    chosen = docs.join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    held = F.pmod("version", F.lit(HELD_OUT)) == 0
    model = Model(chosen.where(~held), scratch)
    keys = ("doc_id", "version", "lang")
    scores = scratch.table(model.scores(docs, *keys), "scores")
    raw = F.col("cost") / MICRO / F.col("n_tokens")
    held_out = scores.where(held & (F.col("n_tokens") > 1)).join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    median = _quantile(_bins(held_out, raw), 0.5, "median").drop("documents")
    pooled = median.where(F.col("lang") == POOLED).select(F.col("median").alias("any_median"))
    drawn = (F.col("cost") / MICRO + DRAWN * F.col("median")) / (F.col("n_tokens") + DRAWN)
    with_median = lambda rows: (
        rows.join(F.broadcast(median), "lang", "left")
        .join(F.broadcast(pooled), F.lit(True), "left")
        .withColumn("median", F.coalesce("median", "any_median"))
        .withColumn("score", drawn)
    )
    high = _quantile(_bins(with_median(held_out), F.col("score")), QUANTILE, "high")
    limits = scratch.table(
        median.join(high, "lang").select(
            "lang", "documents", (F.col("high") + FENCE * (F.col("high") - F.col("median"))).alias("limit")
        ),
        "limits",
    )
    any_limit = limits.where(F.col("lang") == POOLED).select(F.col("limit").alias("any_limit"))
    rated = (
        with_median(scores)
        .join(F.broadcast(limits), "lang", "left")
        .join(F.broadcast(any_limit), F.lit(True), "left")
        .withColumn("limit", F.when(F.col("documents") >= ENOUGH, F.col("limit")).otherwise(F.greatest("limit", "any_limit")))
        .withColumn("score", F.when(F.col("n_tokens") > 1, F.col("score")).otherwise(F.col("median")))
    )
    return rated.select(
        "doc_id",
        "version",
        "lang",
        "n_tokens",
        F.round(F.exp("score"), 3).alias("perplexity"),
        F.round(F.exp("limit"), 3).alias("threshold"),
        F.coalesce(F.col("score") <= F.col("limit"), F.lit(True)).alias("keep"),
    )


def keep_good(df: DataFrame, trusted_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with their own columns only."""
    judged = judge(df, trusted_ids, id_column, text_column, lang_column)
    bad = judged.where(~F.col("keep")).select(
        F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version"), F.col("lang").alias("bad_lang")
    )
    rows = pack(df, doc_id=quoted(id_column), version=F.xxhash64(quoted(text_column).cast("string")), lang=quoted(lang_column))
    same = (
        F.col("doc_id").eqNullSafe(F.col("bad_id"))
        & (F.col("version") == F.col("bad_version"))
        & F.col("lang").eqNullSafe(F.col("bad_lang"))
    )
    return unpack(rows.join(bad, same, "left_anti"), df.columns)
