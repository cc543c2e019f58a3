"""License scans, by DataFrame expressions only.

Templates and texts are lower-cased runs of letters and digits.  A template of
n words is looked for in windows of twice its size class that overlap by half,
so every occurrence lies whole in some window.  MinHash bands (one hash each)
of a window's three-word shingles retrieve templates; exact containment of the
template's shingles in the window's verifies them.  Three words, because a
notice can be as short as "All rights reserved".

A window is signed only if it can match: a match has the contained share of
some template's shingles of that size class, so at least as many of the window's
shingles must be among that class's templates'.  A Bloom filter of bounded size
tells; a crowded one only lets more windows through.

The bands: a whole template makes up at least a quarter of its window's
shingles, and ``bands_for`` gives the number that finds it at the target rate.

Defined results: null text is empty; a text of fewer than three words matches
nothing, and neither does such a template; templates may have any length and
number; rows with equal doc_id are one document, and templates of one
license_id are told apart inside and reported as one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import let
from . import _runtime as rt

# Notices and opening passages of public licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
SHINGLE = 3
CONTAINMENT = 0.8
RECALL = 0.999
#: Half window sizes in words; a template belongs to the least that holds it, and
#: ``sizes_for`` goes on by quarters to the longest template.
SIZES = (3, 4, 5, 6, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60, 75, 94, 118, 148, 185, 232, 290)
#: Of the bitmap of template shingles: bits for each, and bits at least and at most (16 MB).
BITS_PER_SHINGLE, MIN_BITS, MAX_BITS = 64, 1 << 20, 1 << 27
#: Bytes of templates (their band keys, their shingles) up to which they are broadcast; beyond, joined by shuffle with a salt.
BROADCAST_BYTES, SALTS = 64 << 20, 16


def sizes_for(longest: int) -> list[int]:
    out = list(SIZES)
    while out[-1] < longest:
        out.append(out[-1] * 5 // 4)
    return out


def bands_for(recall: float = RECALL, containment: float = CONTAINMENT) -> int:
    """Bands of one row that meet the recall at the least similarity of a match and its window."""
    # A template of one shingle in a window of four; a longer one, matched at the
    # containment limit and up to a quarter below its size class, lies above 1/4 too.
    s = min(0.25, containment / (2 * 1.25 + 1 - containment))
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def words_of(text: Column) -> Column:
    """A text's words; a text without any has the empty word alone, which makes no shingle."""
    return F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _hashes(words: Column) -> Column:
    """The shingle that begins at each word: hashes of its words, each shifted by its place, without array look-ups."""

    def shifted(k: int):
        return lambda a, b: a.bitwiseXOR(F.shiftleft(b, k))

    def joined(h: Column) -> Column:
        n = F.size(h) - (SHINGLE - 1)
        out = F.slice(h, 1, n)
        for k in range(1, SHINGLE):
            out = F.zip_with(out, F.slice(h, k + 1, n), shifted(k))
        return F.when(n >= 1, out).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), joined)


def _shingles(words: Column) -> Column:
    return F.array_distinct(_hashes(words))


def _signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(seed, x))))


def _all(array: str) -> Column:
    """The whole array, as an expression: of a plain column that is exploded Catalyst infers a filter
    and pushes it down, where it would compute everything before it again, the words once for each word."""
    return F.slice(F.col(array), 1, (1 << 31) - 1)


def _starts(at: Column, half: int, need: int) -> Column:
    """The windows of one size that hold ``need`` of the places in at: at most two for each of them."""
    none = F.array().cast("array<bigint>")

    def around(first: Column, last: Column) -> Column:
        low, high = F.greatest(F.ceil((last + SHINGLE - 2 * half) / half), F.lit(0)), F.floor(first / half)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda j: j * half)).otherwise(none)

    spans = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda k: around(F.get(at, k), F.get(at, k + (need - 1))))
    found = F.when(F.size(at) >= need, F.array_distinct(F.flatten(spans))).otherwise(none)
    return F.transform(found, lambda start: F.struct(F.lit(half).alias("half"), start.cast("int").alias("start")))


def _slots(value: Column, words: int) -> list[tuple[Column, Column]]:
    """A hash's two places: word, and bit in it."""
    return [(F.shiftright(value, by + 6).bitwiseAND(words - 1).cast("int"), F.shiftright(value, by).bitwiseAND(63).cast("int")) for by in (0, 29)]


def _filter_of(hashes: DataFrame, count: int) -> tuple[Column, int]:
    """(a Bloom filter of (hash) as an array of 64-bit words, their number), one value of bounded size for all tasks."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, count * BITS_PER_SHINGLE):
        bits *= 2
    n = bits // 64
    places = hashes.select(F.inline(F.array(*[F.struct(word.alias("at"), bit.alias("bit")) for word, bit in _slots(F.col("hash"), n)])))
    words = places.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("word"))
    every = hashes.sparkSession.range(n).join(words, F.col("id") == F.col("at"), "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x.getField("word")).alias("bits")).scalar(), n


def _holds(filter_words: Column, value: Column, n: int) -> Column:
    one, two = (F.getbit(F.get(filter_words, word), bit) == 1 for word, bit in _slots(value, n))
    return one & two


def builtin_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("template")) for k, v in TEMPLATES.items()])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, license_id, containment, first_word, windows) of every license found.

    first_word is where the first matching window begins, windows how many match.
    """
    spark = docs.sparkSession
    rt.prepare(spark)
    bands = bands_for(recall, containment)
    given = (templates if templates is not None else builtin_templates(spark)).select("license_id", words_of(F.col("template")).alias("words")).where(F.size("words") >= SHINGLE)
    given = rt.materialize(given.select("license_id", F.size("words").alias("n_words"), _shingles(F.col("words")).alias("t_shingles")), "templates")
    shape = given.agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("longest"), F.sum(F.size("t_shingles")).alias("shingles")).first()
    sizes = sizes_for(shape.longest or 0)
    half = F.array_min(F.filter(F.lit(sizes), lambda s: s >= F.col("n_words")))
    wanted = rt.materialize(given.select("license_id", half.alias("t_half"), "t_shingles", _signature(F.col("t_shingles"), bands).alias("t_values"), F.monotonically_increasing_id().alias("t_id")), "signed-templates")
    # Of each size class that has a template, the fewest shingles of a match.
    least = F.ceil(containment * F.size("t_shingles") - 1e-9)
    needs = {r.t_half: max(1, r.need) for r in wanted.groupBy("t_half").agg(F.min(least).alias("need")).collect()}
    # The filter has every shingle, and every shingle with its size class.
    own = F.explode("t_shingles").alias("shingle")
    marks = wanted.select(own, "t_half").select(F.explode(F.array("shingle", F.xxhash64("shingle", "t_half"))).alias("hash"))
    bits, n_words = _filter_of(marks, 2 * (shape.shingles or 0))

    def chosen(own: Column) -> Column:
        """The windows that can match, from the places whose shingles the filter has."""

        def places(hashes: Column) -> Column:  # of most texts there are none
            every = F.transform(hashes, lambda h, i: F.when(_holds(own, h, n_words), F.struct(i.alias("i"), h.alias("h"))))
            return F.when(F.exists(hashes, lambda h: _holds(own, h, n_words)), F.filter(every, lambda x: x.isNotNull()))

        def of_class(found: Column, half: int, need: int) -> Column:
            mine = F.filter(found, lambda x: _holds(own, F.xxhash64(x.getField("h"), F.lit(half)), n_words))
            return let(F.transform(mine, lambda x: x.getField("i")), lambda at: _starts(at, half, need))

        def by_class(found: Column) -> Column:
            return F.when(found.isNotNull(), F.flatten(F.array(*[of_class(found, h, n) for h, n in sorted(needs.items())])))

        return let(let(F.col("hashes"), places), by_class)

    # No conditions on rows here: pushed down, they would compute the words twice.  Hashes and Bloom
    # filter are named once below, so Catalyst puts the filter into the expression as one value; as
    # a column of its own it would be copied into every row.  Words are named twice and stay a column.
    worded = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")).select("doc_id", "words", _hashes(F.col("words")).alias("hashes"), bits.alias("bits"))
    starts = let(F.col("bits"), chosen) if needs else F.array().cast("array<struct<half:int,start:int>>")
    placed = worded.select("doc_id", "words", starts.alias("starts"))
    windows = placed.select("doc_id", "words", F.inline(_all("starts"))).select("doc_id", "half", "start", let(F.slice("words", F.col("start") + 1, F.col("half") * 2), _shingles).alias("shingles"))
    signed = windows.select("*", _signature(F.col("shingles"), bands).alias("values")).select("*", F.posexplode(_all("values")).alias("band", "value"))

    def bounded(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= BROADCAST_BYTES else df

    keys = wanted.select("t_id", "t_half", "t_values", F.posexplode("t_values").alias("t_band", "t_value"))
    found = signed.join(bounded(keys, shape.n * bands * (bands + 8) * 8), (F.col("half") == F.col("t_half")) & (F.col("band") == F.col("t_band")) & (F.col("value") == F.col("t_value")))
    # A window meets a template once, in the first band they share.
    found = found.where(F.array_position(F.zip_with("values", "t_values", lambda a, b: a == b), True) == F.col("band") + 1).select("doc_id", "t_id", "start", "shingles")
    full = wanted.select(F.col("t_id").alias("f_id"), "license_id", "t_shingles")
    if (size := (shape.shingles or 0) * 8) <= BROADCAST_BYTES:
        met = found.join(bounded(full, size), F.col("t_id") == F.col("f_id"))
    else:  # one license may be found in a third of all documents
        salted = full.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.join(salted, (F.col("t_id") == F.col("f_id")) & (F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)) == F.col("t_salt")))
    share = F.size(F.array_intersect("t_shingles", "shingles")) / F.size("t_shingles")
    verified = met.select("doc_id", "license_id", "start", share.alias("share")).where(F.col("share") >= containment)
    each = verified.groupBy("doc_id", "license_id", "start").agg(F.max("share").alias("share"))
    return each.groupBy("doc_id", "license_id").agg(F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count(F.lit(1)).alias("windows"))
