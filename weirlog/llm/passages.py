"""Removing words of passages that an earlier document has, located by Aho-Corasick automata.

A window is a fixed number of consecutive words. Its anchor is the smallest hash
among its short word grams, so equal windows have equal anchors wherever they
stand, and only one gram in five is an anchor at all. The anchors are what is
shuffled: those of one document only are dropped, and for the others the first
document of each is known.

Every stretch of windows whose anchors share a first document goes to the shard
of that document. The stretches of the first document itself are the recurring
passages. A shard cuts them into pieces of seven words, of which each window of
thirteen holds a whole one, compiles the pieces, a word as one letter, into
automata of bounded size, and streams the other documents' stretches through them. A piece
that is found is followed word by word to both sides, which confirms the windows
around it. A shard with many stretches is dealt out to many tasks, each with the same
passages.

Windows that no passage of their anchor's first document has can still recur among later
documents. They are few; the same is done for them once more with the 128-bit hash
of the whole window in place of the anchor, which leaves none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.llm.rows import pack, quoted, unpack
from weirlog.session import Scratch

WINDOW = 13
GRAM = 5
TIES = 1 << 16
TEXT_BYTES = 4 << 20  # of texts hashed at once
SHARD_WORDS = 50_000  # of passages in a shard, on the average
BLOCK_WORDS = 1_000_000  # of stretches that a task streams for a shard
PIECES = 100_000  # in one automaton
STEP = 64
LAST_ID = (1 << 63) - 1

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _FACTOR
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a column of texts: where they stand, and their hashes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        solid = _SOLID[self.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        texts_begin = ends[:-1][ends[:-1] < len(solid)]
        begins[texts_begin] = solid[texts_begin]
        letters = self.data[solid].astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero(begins[solid])  # of each word's first letter among all letters
        sizes = np.diff(np.append(at, len(letters)))
        self.starts = np.flatnonzero(begins)
        self.stops = self.starts + sizes
        # Text i has the words bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, ends)
        powers = np.multiply.accumulate(np.full(sizes.max(initial=1), _FACTOR))
        letters *= powers[np.arange(len(letters)) - np.repeat(at, sizes)]
        self.hashes = _mixed(np.add.reduceat(letters, at)) if len(at) else np.zeros(0, np.uint64)

    def anchors(self, window: int, gram: int) -> np.ndarray:
        """For each word the smallest gram hash of the window that starts there, if there is one."""
        n = len(self.hashes) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        grams = np.zeros(len(self.hashes) - gram + 1, np.uint64)
        for i in range(gram):
            grams = grams * _FACTOR + self.hashes[i : i + len(grams)]
        least, width, wanted = _mixed(grams), 1, window - gram + 1
        while width < wanted:
            more = min(width, wanted - width)
            least = np.minimum(least[: len(least) - more], least[more:])
            width += more
        return least.view(np.int64)

    def text(self, i: int, j: int) -> str:
        """Words i to j (exclusive), joined by one blank."""
        raw = self.data[self.starts[i] : self.stops[j - 1]].tobytes()
        return b" ".join(raw.split()).decode()


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text each; a longer text comes alone."""
    for batch in batches:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
        at = size = 0
        for i, more in enumerate(sizes):
            if i > at and size + more > TEXT_BYTES:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += more
        if at < batch.num_rows:
            yield batch.slice(at)


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _anchor_rows(window: int, gram: int):
    """Each document's anchors; one that neighbouring windows share comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            words = Words(batch.column("text"))
            keys = words.anchors(window, gram)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words.bounds))[: len(keys)]
            whole = np.arange(len(keys)) + window <= words.bounds[doc + 1]
            keys, doc = keys[whole], doc[whole]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            again = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[new]), batch.column("id").take(again), batch.column("tie").take(again)],
                ["key", "id", "tie"],
            )

    return run


def _lists(column: pa.Array, *fields: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The fields of each list of structs, as arrays."""
    ends = column.offsets.to_numpy().tolist()
    values = [column.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    for i, j in zip(ends, ends[1:]):
        yield tuple(v[i:j] for v in values)


STRETCH = "first bigint, id bigint, version bigint, at int, n int, text string, often binary"


def _stretches(window: int, gram: int | None):
    """Stretches of neighbouring windows with the same first document.

    ``live`` lists anchors with their first document and whether more than one
    other row has them, or places of windows where ``gram`` is None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        names = ["first", "id", "version", "at", "n", "text", "often"]
        for batch in _small(batches):
            out: list[list] = [[] for _ in names]
            words = Words(batch.column("text"))
            anchors = words.anchors(window, gram) if gram else None
            live = _lists(batch.column("live"), "key", "first", "often")
            bounds = words.bounds.tolist()
            for (doc_id, version), (keys, firsts, oftens), start, stop in zip(
                _columns(batch, "id", "version"), live, bounds, bounds[1:]
            ):
                n = stop - start - window + 1
                if n <= 0:
                    continue
                if gram:
                    order = np.argsort(keys)
                    keys = keys[order]
                    mine = anchors[start : start + n]
                    place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    known = keys[place] == mine
                    place = order[place]
                    first, often = np.where(known, firsts[place], 0), oftens[place]
                else:
                    known, first, often = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
                    here = keys < n
                    known[keys[here]], first[keys[here]] = True, firsts[here]
                edges = np.flatnonzero((known[1:] != known[:-1]) | (first[1:] != first[:-1])) + 1
                edges = [0, *edges.tolist(), n]
                for i, j in zip(edges, edges[1:]):
                    if known[i]:
                        text = words.text(start + i, start + j + window - 1)
                        row = (int(first[i]), doc_id, version, i, j - i, text, often[i:j].tobytes())
                        for column, value in zip(out, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


class _Shard:
    """An automaton over pieces of passages, each with the places it was cut from."""

    def __init__(self, size: int):
        self.size = size
        self.letters: dict[str, str] = {}
        self.passages: list[tuple[int, str]] = []
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)

    def add(self, first: int, words: list[str]) -> None:
        text = "".join([self.letters.setdefault(w, chr(len(self.letters) + 1)) for w in words])
        for at in range(0, len(text) - self.size + 1, self.size):
            self.places[text[at : at + self.size]].append((len(self.passages), at))
        self.passages.append((first, text))

    def compiled(self) -> _Shard:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for piece, places in self.places.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()
        return self

    def mark(self, doc_id: int, words: list[str], window: int, known: bytearray, late: bytearray) -> None:
        """Mark the windows that a passage has, and those that one of an earlier document has."""
        text = "".join([self.letters.get(w, "\0") for w in words])
        last = len(text) - window
        for end, places in self.automaton.iter(text):
            at = end - self.size + 1
            low, high = max(0, at + self.size - window), min(at, last)
            for number, place in places:
                # Windows around a piece are known at once where it is one of a long run.
                if known.find(0, low, high + 1) < 0 and late.find(0, low, high + 1) < 0:
                    break
                first, passage = self.passages[number]
                i, j = _run(text, at, passage, place, self.size)
                if j - i >= window:
                    marks = b"\1" * (j - i - window + 1)
                    known[i : j - window + 1] = marks
                    if first < doc_id:
                        late[i : j - window + 1] = marks


def _run(text: str, at: int, passage: str, place: int, size: int) -> tuple[int, int]:
    """The stretch of ``text`` around a common piece that agrees with the passage."""
    i, k = at, place
    while i and k:
        step = min(STEP, i, k)
        if text[i - step : i] == passage[k - step : k]:
            i, k = i - step, k - step
        else:
            while text[i - 1] == passage[k - 1]:
                i, k = i - 1, k - 1
            break
    j, k = at + size, place + size
    while j < len(text) and k < len(passage):
        step = min(STEP, len(text) - j, len(passage) - k)
        if text[j : j + step] == passage[k : k + step]:
            j, k = j + step, k + step
        else:
            while text[j] == passage[k]:
                j, k = j + 1, k + 1
            break
    return i, j


def _shards(passages: list[tuple[int, str]], window: int) -> Iterator[_Shard]:
    """Automata over all pieces of the passages; each window holds a whole piece."""
    size = (window + 1) // 2
    shard = _Shard(size)
    for first, text in passages:
        words = text.split(" ")
        most = PIECES * size
        for start in range(0, len(words) - window + 1, most):
            if len(shard.places) >= PIECES:
                yield shard.compiled()
                shard = _Shard(size)
            shard.add(first, words[start : start + most + window - 1])
    if shard.places:
        yield shard.compiled()


FOUND = "id bigint, version bigint, at int, n int, key binary"


def _locate(window: int):
    """Windows that an earlier document has, as spans of words; the hashes of those unknown to the automata."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_columns(table, "first", "id", "version", "at", "text", "often"))
        passages = sorted((first, text) for first, i, _, _, text, _ in rows if i == first)
        others = [(i, version, at, t.split(" "), often) for first, i, version, at, t, often in rows if i != first]
        marks = [(bytearray(len(o)), bytearray(len(o))) for *_, o in others]
        for shard in _shards(passages, window):
            for (doc_id, _, _, words, _), (known, late) in zip(others, marks):
                shard.mark(doc_id, words, window, known, late)
        out: list[list] = [[] for _ in range(5)]
        for (doc_id, version, at, words, often), (known, late) in zip(others, marks):
            gone = np.frombuffer(b"\0%b\0" % late, np.uint8)
            turns = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
            for i, j in zip(turns[::2], turns[1::2]):
                for column, value in zip(out, (doc_id, version, at + i, j - i + window - 1, None)):
                    column.append(value)
            # What only the first document and this one can have does not recur elsewhere.
            left = np.frombuffer(often, bool) & (np.frombuffer(known, np.uint8) == 0)
            for i in np.flatnonzero(left).tolist():
                key = xxhash.xxh3_128_digest(" ".join(words[i : i + window]).encode())
                for column, value in zip(out, (doc_id, version, at + i, window, key)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "version", "at", "n", "key"])

    return run


def _recurring(rows: DataFrame) -> DataFrame:
    """Keys of more than one document, with the first of them; combined before the shuffle."""
    ends = rows.groupBy("key").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), (F.count("*") > 2).alias("often")
    )
    return ends.where(F.col("first") != F.col("last")).select("key", "first", "often")


def _located(stretches: DataFrame, window: int) -> DataFrame:
    """All stretches through the automata of their shards."""
    n = stretches.agg(F.sum(F.when(F.col("id") == F.col("first"), F.col("n")))).first()[0] or 0
    shards = max(1, n // SHARD_WORDS)
    rows = stretches.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    blocks = F.ceil(F.sum(F.when(F.col("id") != F.col("first"), F.col("n")).otherwise(0)) / BLOCK_WORDS)
    sizes = rows.groupBy("shard").agg(F.greatest(blocks, F.lit(1)).alias("blocks"))
    rows = rows.join(sizes, "shard")
    passage = F.col("id") == F.col("first")
    own = F.pmod(F.xxhash64("id", "version", "at"), F.col("blocks"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    rows = rows.withColumn("block", F.explode(F.when(passage, everywhere).otherwise(F.array(own)))).drop("blocks")
    return rows.groupBy("shard", "block").applyInArrow(_locate(window), FOUND)


def spans(docs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """Spans of words (``at``, ``n``) of each document's windows that an earlier one has.

    ``docs`` has ``id``, ``version`` and ``tie`` (hashes of the text) and ``text``
    as bytes.
    """
    rows = docs.select("id", "tie", "text").mapInArrow(_anchor_rows(window, gram), "key bigint, id bigint, tie int")
    places = scratch.table(rows, "anchors")
    known = scratch.table(_recurring(places), "recurring-anchors")
    live = places.join(known, "key").groupBy("id", "tie").agg(
        F.collect_list(F.struct("key", "first", "often")).alias("live")
    )
    live = scratch.table(live, "live-anchors")
    read = ["id", "version", "text", "live"]
    stretches = docs.join(live, ["id", "tie"]).select(*read).mapInArrow(_stretches(window, gram), STRETCH)
    found = scratch.table(_located(scratch.table(stretches, "stretches"), window), "located")
    late = found.where("key is null").drop("key")
    rest = found.where("key is not null")
    known = scratch.table(_recurring(rest), "recurring-windows")
    places = F.struct(F.col("at").cast("bigint").alias("key"), "first", "often")
    live = rest.join(known, "key").groupBy("id", "version").agg(F.collect_list(places).alias("live"))
    live = scratch.table(live, "live-windows")
    if live.isEmpty():
        return late
    stretches = docs.join(live, ["id", "version"]).select(*read).mapInArrow(_stretches(window, None), STRETCH)
    found = scratch.table(_located(scratch.table(stretches, "stretches"), window), "located")
    return late.unionByName(found.where("key is null").drop("key"))


def _cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    """The words outside of the spans, and how many words there were and went."""
    kept, n_words, n_removed = [], [], []
    for text, gone in zip(texts.to_pylist(), cuts.to_pylist()):
        words = text.split()
        stay = np.ones(len(words), bool)
        for span in gone or ():
            stay[span["at"] : span["at"] + span["n"]] = False
        left = words if stay.all() else [words[i] for i in np.flatnonzero(stay)]
        kept.append(b" ".join(left).decode())
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
    columns = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
    return pa.StructArray.from_arrays(columns, ["kept", "n_words", "n_removed"])


def drop_repeated_passages(
    df: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM
) -> DataFrame:
    """Every row with ``kept`` (its words that stay, joined by one blank), ``n_words`` and ``n_removed``.

    Words are parted by blanks and ASCII line and tab characters and compared as
    they are. Each word inside a window of ``window`` words goes if that window
    also starts in a row of smaller id; windows are judged on the input. A text of
    fewer words, an empty and a null text lose nothing; a null text has no
    words. Rows that share an id are no reason for each other to lose anything.
    An id is a whole number, and a null one counts as the largest there is.
    An empty table gives an empty result. Input columns named ``kept``, ``n_words`` or
    ``n_removed`` are replaced.
    """
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    number = F.coalesce(quoted(id_column).cast("bigint"), F.lit(LAST_ID))
    version = F.xxhash64(text)
    docs = pack(df, id=number, version=version, text=text.cast("binary"))
    plain = df.select(
        number.alias("id"),
        version.alias("version"),
        F.pmod(version, F.lit(TIES)).cast("int").alias("tie"),
        text.cast("binary").alias("text"),
    )
    left = Scratch(df.sparkSession)  # what the result reads
    with Scratch(df.sparkSession) as scratch:
        cuts = spans(plain, window, gram, scratch).groupBy("id", "version")
        cuts = left.table(cuts.agg(F.collect_list(F.struct("at", "n")).alias("cuts")), "repeated-spans")
    cut = F.arrow_udf(_cut, "struct<kept:string,n_words:bigint,n_removed:bigint>")
    rows = docs.join(cuts, ["id", "version"], "left").withColumn("cut", cut("text", "cuts"))
    return unpack(rows, df.columns, **{c: F.col(f"cut.{c}") for c in ("kept", "n_words", "n_removed")})
