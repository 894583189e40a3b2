"""Plain restatements of the operators' rules, and awkward small tables."""

from __future__ import annotations

import re

import xxhash

# Two documents that differ in one word of many, and everything that tends to break things.
LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(3000))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "two words",
    "Three little words",
    "Three little words",
    "Three LITTLE words",
    "ünïcödé wörds Ärger straße 日本 語",
    "<|endoftext|> is ordinary here, isn't it?  Two blanks.\r\n\r\nx",
    LONG,
    LONG.replace("word5 ", "other ", 1),
    LONG + " tail",
    "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
    "x " * 40 + "Licensed under CC BY-NC 4.0. Again: cc by nc cc by nc",
]


def documents(spark, texts=TEXTS, clashing=()):
    """A row per text; a repeated row, a null id and columns that clash by name."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    if rows:
        rows += [rows[-1], (None, "no id at all here", "en", "src1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in clashing:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def kept_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def simhash(text):
    found = blank_words(text)
    shingles = [found[i : i + 3] for i in range(len(found) - 2)] or ([found] if found else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}
