"""Licence notices in documents, found by diagonal voting.

Every rolling hash of three words of a document is joined to the positions at
which the templates have it. A match votes for a diagonal: its position in the
document less that in the template. Votes are added up per document, template
and diagonal. A phrase stands where its diagonal has all of its votes; a longer
notice may have words put in or left out, so neighbouring diagonals that follow
each other in the document are merged into a span. Spans with enough votes
are verified against the words of the document.

The join is a broadcast: the templates are a fixed list of bounded size. Votes
are combined in the task that reads the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlog.llm.rows import quoted
from weirlog.llm.words import gram_hashes, words
from weirlog.session import Scratch

K = 3
GAP = 8  # words put in or left out between two matching stretches of a span
VOTES = 0.5  # of a template's votes that make a candidate
COVERAGE = 0.7  # of a template's word sequences that make a span,
SHORT = 12  # or all of them if they are no more than these: one word tells licences apart
BROADCAST_ROWS = 1_000_000

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of public licence notices and their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("reserved", "all rights reserved"),
]
TEMPLATES = [*((label, text, True) for text, label in PHRASES.items()), *((*notice, False) for notice in NOTICES)]


def _grams(found: list[bytes]) -> list[bytes]:
    return [b" ".join(found[i : i + K]) for i in range(len(found) - K + 1)]


def rolling_hashes(text: Column) -> Column:
    """One hash for each word of a text; 0 where too few words follow."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        arrays = []
        for text in texts.cast(pa.large_binary()):
            found = words(text.as_py() or b"")
            hashes = np.zeros(len(found), np.int64)
            grams = gram_hashes(found, K)
            hashes[: len(grams)] = grams
            arrays.append(hashes)
        ends = np.cumsum([0, *map(len, arrays)])
        values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    return run(text)


def coverage(text: Column, spans: Column, templates: list[tuple[str, str, bool]]) -> Column:
    """For each span (``template``, ``first``, ``last``) the share of the template's word sequences in it."""
    wanted = [set(_grams(words(t.encode()))) for _, t, _ in templates]

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.cast(pa.large_binary()), lists.to_pylist()):
            found = words(text.as_py() or b"")
            shares = []
            for s in spans:
                grams = wanted[s["template"]]
                shares.append(len(grams.intersection(_grams(found[s["first"] : s["last"] + K]))) / len(grams))
            out.append(shares)
        return pa.array(out, pa.list_(pa.float64()))

    return run(text, spans)


def _template_rows(spark, templates) -> DataFrame:
    rows = []
    for number, (_, text, _) in enumerate(templates):
        hashes = gram_hashes(words(text.encode()), K).tolist()
        if not hashes:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(h, number, at) for at, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "hash bigint, template int, at int")


def scan(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: list[tuple[str, str, bool]] = TEMPLATES,
) -> tuple[DataFrame, DataFrame]:
    """The documents' word counts and the verified spans.

    The first table has ``doc_id``, ``version`` (a hash of the text) and ``n_words``;
    the second ``doc_id``, ``version``, ``label``, ``phrase`` (whether the template
    is one that must stand word for word), ``first`` and ``last`` word of the span,
    from 0, and its ``coverage``. A null or empty text has no words and no span.
    Rows that agree in id and text are one document. Other columns are not
    looked at.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    text = quoted(text_column).cast("string")
    docs = df.select(quoted(id_column).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    rolled = docs.select("doc_id", "version", F.posexplode_outer(rolling_hashes(F.col("text"))).alias("pos", "hash"))
    matched = rolled.join(F.broadcast(_template_rows(spark, templates)), "hash", "left")
    # A place counts once, however often its row is repeated; the words without a match are one group.
    places = matched.groupBy(
        "doc_id", "version", "template", "at", F.when(F.col("template").isNotNull(), F.col("pos")).alias("pos")
    ).agg(F.max(F.col("pos") + 1).alias("words"))
    diagonals = places.groupBy("doc_id", "version", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.max("words").alias("words"),
    )
    diagonals = scratch.table(diagonals, "diagonals")
    counted = diagonals.groupBy("doc_id", "version").agg(
        F.coalesce(F.max("words"), F.lit(0)).cast("bigint").alias("n_words")
    )

    sizes = F.from_json(F.lit(str([len(words(t.encode())) - K + 1 for _, t, _ in templates])), "array<int>")
    enough = F.from_json(
        F.lit(str([1.0 if len(words(t.encode())) - K < SHORT else COVERAGE for _, t, _ in templates])), "array<double>"
    )
    phrase = F.from_json(F.lit(str([int(p) for _, _, p in templates])), "array<int>")
    hits = diagonals.where("template is not null").withColumns(
        {"size": F.get(sizes, F.col("template")), "phrase": F.get(phrase, F.col("template")) == 1}
    )
    exact = hits.where(F.col("phrase") & (F.col("votes") == F.col("size")))
    along = Window.partitionBy("doc_id", "version", "template").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > GAP) | (
        F.col("first") - F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)) > GAP + K
    )
    spans = (
        hits.where(~F.col("phrase"))
        .withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy("doc_id", "version", "template", "span", "size", "phrase")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .where(F.col("votes") >= VOTES * F.col("size"))
    )
    columns = ["doc_id", "version", "template", "phrase", "first", "last"]
    candidates = scratch.table(exact.select(*columns).unionByName(spans.select(*columns)), "candidates")

    few = candidates.count() <= BROADCAST_ROWS
    per_document = candidates.groupBy(F.col("doc_id").alias("found_id"), F.col("version").alias("found_version")).agg(
        F.collect_list(F.struct("template", "phrase", "first", "last")).alias("spans")
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version"))
    rows = docs.join(F.broadcast(per_document) if few else per_document, same)
    shares = coverage(F.col("text"), F.col("spans"), templates)
    labels = F.from_json(F.lit(str([label for label, _, _ in templates]).replace("'", '"')), "array<string>")
    verified = (
        rows.select("doc_id", "version", F.explode(F.arrays_zip("spans", shares.alias("share"))).alias("s"))
        .select(
            "doc_id",
            "version",
            F.get(labels, F.col("s.spans.template")).alias("label"),
            F.col("s.spans.phrase").alias("phrase"),
            F.col("s.spans.first").cast("bigint").alias("first"),
            (F.col("s.spans.last") + K - 1).cast("bigint").alias("last"),
            F.col("s.share").alias("coverage"),
            F.get(enough, F.col("s.spans.template")).alias("enough"),
        )
        .where("coverage >= enough")
        .drop("enough")
        .distinct()
    )
    return counted, verified


def summary(counted: DataFrame, verified: DataFrame) -> DataFrame:
    """One row per document: its words, where phrases stand, its labels and the best coverage.

    Without a span the counts are 0, the places null and the labels empty.
    """
    base = lambda column: F.when(F.col("phrase"), column)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = verified.groupBy(F.col("doc_id").alias("found_id"), F.col("version").alias("found_version")).agg(
        F.count_if("phrase").alias("n_base"),
        F.min(base(F.col("first"))).alias("first_word"),
        F.max(base(F.col("first"))).alias("last_word"),
        joined(F.collect_set(base(F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version"))
    return counted.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
