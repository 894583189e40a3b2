"""Removing passages that occurred before, by overlapping three-line windows.

DataFrame functions only. A text is cut into lines, and a line into its
sentences, so that a passage inside a paragraph that was never wrapped is found
like one that has its own lines. Each window of three consecutive non-blank
units is hashed to 128 bits. One aggregate finds the windows that occur more
than once and the first document of each; a join marks all their places. In a
document the marked windows are merged into covered stretches, which are cut
out of the text.

The aggregate is combined before its shuffle and the join is one that Spark can
split, so a window that millions of documents share is no hot spot. Beyond
that only the windows of one document are ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.rows import pack, quoted, unpack
from weirlog.session import Scratch

UNIT = r"[^\n]*?[.!?] |[^\n]*\n|[^\n]+"
BLANKS = " \t\r\n"
MIN_CHARS = 50  # of a window's units: shorter ones recur by chance


def units(text: Column) -> Column:
    """The lines and sentences of a text; joined they are the text again."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def _trimmed(unit: Column) -> Column:
    return F.btrim(unit, F.lit(BLANKS))


def windows(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each window's hashes ``a`` and ``b`` with its place ``at`` among the non-blank units."""
    filled = F.filter(F.transform(units(F.col("text")), _trimmed), lambda t: t != "")
    cut = docs.withColumn("filled", filled)

    def window(i: Column) -> Column:
        one, two, three = (F.get("filled", i + k) for k in range(3))
        long = F.length(one) + F.length(two) + F.length(three) >= min_chars
        return F.when(
            long,
            F.struct(
                i.alias("at"), F.xxhash64(one, two, three).alias("a"), F.xxhash64(three, one, two).alias("b")
            ),
        )

    places = F.when(F.size("filled") >= 3, F.sequence(F.lit(0), F.size("filled") - 3))
    found = cut.select("doc_id", "version", F.explode(F.transform(places, window)).alias("w"))
    return found.where("w is not null").select("doc_id", "version", "w.at", "w.a", "w.b")


def covered(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per document the sorted, disjoint stretches ``[first, last]`` to cut out."""
    all_windows = windows(docs, min_chars)
    repeated = (
        all_windows.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
        .where("n > 1")
        .drop("n")
    )
    # Written down, so that both sides of the join are plain and a hot window can be split.
    repeated = Scratch(docs.sparkSession).table(repeated, "repeated-windows")
    marked = all_windows.join(repeated, ["a", "b"]).repartition("doc_id", "version")
    # In the first document only the first place of a window stays.
    same = Window.partitionBy("doc_id", "version", "a", "b").orderBy("at")
    # A first id of null means that no document of the window has one.
    later = (~F.col("doc_id").eqNullSafe(F.col("first_id"))) | (F.rank().over(same) > 1)
    cut = marked.withColumn("later", later).where("later").select("doc_id", "version", "at")
    along = Window.partitionBy("doc_id", "version").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(along) > 3, F.lit(True))
    return (
        cut.withColumn("gap", gap)
        .withColumn("stretch", F.sum(F.col("gap").cast("int")).over(along))
        .groupBy("doc_id", "version", "stretch")
        .agg(F.min("at").alias("first"), (F.max("at") + 2).alias("last"))
        .groupBy("doc_id", "version")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))
    )


def without(rows: DataFrame) -> DataFrame:
    """Texts without their ``cuts``, as column ``kept``; null where nothing is cut."""
    index = F.filter(
        F.sequence(F.lit(0), F.size("all") - 1), lambda i: _trimmed(F.get("all", i)) != ""
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: F.get("index", c["last"]) + 1))
    stops = F.concat(F.transform("cuts", lambda c: F.get("index", c["first"])), F.array(F.size("all")))
    stretches = F.arrays_zip(starts.alias("start"), stops.alias("stop"))
    kept = F.transform(
        stretches, lambda s: F.array_join(F.slice("all", s["start"] + 1, s["stop"] - s["start"]), "")
    )
    return (
        rows.withColumn("all", F.when(F.col("cuts").isNotNull(), units(F.col("text"))))
        .withColumn("index", index)
        .withColumn("kept", F.array_join(kept, ""))
    )


def drop_repeated_lines(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Every row, its text without passages that occurred before, and ``n_cut`` units cut.

    A window of three non-blank units of ``min_chars`` characters together
    stays at its first place (smallest id, then first in the text) and goes
    everywhere else, blank units inside it too. What is kept is kept byte for
    byte. A text of fewer than three units, an empty and a null text stay as
    they are; a text that repeats as a whole loses all of its units. A null id
    comes after all others. Rows that agree in id and text count as one
    document and are cut alike; rows that agree in the id only all count as the
    first document where their id is the smallest. An input column named
    ``n_cut`` is replaced.
    """
    text, doc_id = quoted(text_column), quoted(id_column)
    docs = pack(df, doc_id=doc_id, text=text, version=F.xxhash64(text))
    cuts = covered(docs, min_chars).select(
        F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), "cuts"
    )
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("version") == F.col("cut_version"))
    rows = without(docs.join(cuts, same, "left"))
    n_cut = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1)
    return unpack(
        rows,
        df.columns,
        **{text_column: F.coalesce("kept", "text"), "n_cut": F.coalesce(n_cut, F.lit(0)).cast("bigint")},
    )
