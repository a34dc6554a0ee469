"""License scans: phrases that name a license, and an exact set-similarity join of text blocks with license notices.

A template is a notice as a set of words.  A block is so many words in a row: templates of up to 2 ** c words are held
against blocks of 2 ** (c + 1) words that start at every multiple of 2 ** c, so that a passage of a template's length is
whole in one block.  A template is found in a block that holds at least ``THRESHOLD`` of its words (containment).

1. The templates' words are counted over all documents and ordered from rare to frequent; a word is its rank from then on.
2. Blocks are cut down to the ranks that templates of their size have, in order.  Words of no template decide nothing.
3. A template of s words that needs o of them shares one of its first s - o + 1 with any block that meets it, and so does
   the block with b ranks by its first b - o + 1.  These prefixes are joined on the rank.
4. Length filter: b >= o.  Positional filter: what can still follow in both, min(s - i, b - j), must reach o.
5. What is left is verified on the whole sets, once: at the first rank that both have.

Only blocks with a prefix rank leave the first step, as arrays of ranks: no text is shuffled.

Rows: null or empty text has no words and no labels.  Repeated rows get equal results, each its own; an empty table gives an
empty result; other columns are ignored.  Texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bytewords import DIGITS, LETTERS, cut, slices, table
from gristmill.storage import materialize, small_batches

THRESHOLD = 0.9
#: Words of templates that tasks are given; beyond it, scan in several runs.
MOST_TOKENS = 200_000
#: Rows of the templates' prefixes that are sent to all tasks; a longer table is joined.
FEW_PREFIXES = 20_000
KEPT = table(LETTERS + DIGITS)

# fixed values: phrases that name a license, and its label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: wording of public license notices, and their labels
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("epl", "made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)


def words(text: str) -> list[str]:
    return cut(pa.array([text], pa.string()), KEPT)[0].to_pylist()


def stride(n_words: int) -> int:
    """The least power of two, 8 or more, that is no less than the number of words."""
    return max(8, 1 << (n_words - 1).bit_length())


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's distinct words a block must hold."""
    return max(1, math.ceil(size * threshold - 1e-9))


def _counts(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each token occurs in all documents."""
    known = pa.array(tokens, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                code = pc.index_in(cut(batch.column(0)[i:j], KEPT)[0], value_set=known).drop_null().to_numpy()
                n += np.bincount(code, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known)), pa.int64()), pa.array(n)], ["token", "n"])

    found = docs.select(_text()).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row a token
    return {tokens[r["token"]]: r["n"] for r in found}


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


class Index:
    """The templates as sets of ranks, by stride: what blocks are cut down to, and the prefixes that they are joined on."""

    def __init__(self, templates: Sequence[tuple[str, str]], counts: dict[str, int], threshold: float):
        self.tokens = sorted({w for _, t in templates for w in words(t)}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.tokens)}
        self.rows = []
        for label, t in templates:
            found = words(t)
            ranks = sorted({rank[w] for w in found})
            if ranks:
                self.rows.append((stride(len(found)), label, ranks, needed(len(ranks), threshold)))
        self.strides = sorted({r[0] for r in self.rows})
        self.least = {s: min(r[3] for r in self.rows if r[0] == s) for s in self.strides}
        self.member = {s: self._mask(s, lambda r: r[2]) for s in self.strides}
        self.prefix = {s: self._mask(s, lambda r: r[2][: len(r[2]) - r[3] + 1]) for s in self.strides}

    def _mask(self, s: int, part) -> np.ndarray:
        out = np.zeros(len(self.tokens), bool)
        for r in self.rows:
            if r[0] == s:
                out[part(r)] = True
        return out

    def prefixes(self, spark: SparkSession) -> DataFrame:
        """stride, rank, i (its place), label, size, needed, ranks: a row for each rank of a template's prefix."""
        rows = [(s, k, i, label, len(ranks), o, ranks) for s, label, ranks, o in self.rows for i, k in enumerate(ranks[: len(ranks) - o + 1])]
        return spark.createDataFrame(rows, "stride int, rank int, i int, label string, size int, needed int, ranks array<int>")

    def blocks(self, rank: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """stride, document of each block, its first entry, and the entries (ranks in order), of blocks with a prefix rank.

        ``rank``, ``doc`` and ``place`` are those of the words that templates have.
        """
        for s in self.strides:
            own = np.flatnonzero(self.member[s][rank])
            k, d, r = place[own] // s, doc[own], rank[own]
            earlier = k > 0  # each word is in the block that starts before it, and in the one before that
            d, k, r = np.concatenate([d, d[earlier]]), np.concatenate([k, k[earlier] - 1]), np.concatenate([r, r[earlier]])
            hit = self.prefix[s][r]
            if not hit.any():
                continue
            span = int(k.max()) + 1
            block = d * span + k
            near = np.isin(block, np.unique(block[hit]))
            pairs = np.unique(block[near] * len(self.tokens) + r[near])
            block, r = pairs // len(self.tokens), pairs % len(self.tokens)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            yield s, block[first] // span, first, r


def scanned(docs: DataFrame, index: Index, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, row (a number of its own), n_words, n_base, first_word, last_word, base (labels), blocks (stride, ranks); stored."""
    tokens = pa.array(index.tokens, pa.string())
    spoken = [(p.split(), label) for p, label in phrases.items()]
    said = pa.array(sorted({w for p, _ in spoken for w in p}), pa.string())
    code_of = {w: k for k, w in enumerate(said.to_pylist())}
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<stride:int,ranks:array<int>>>"

    def places(found: pa.Array, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, str]]:
        code = pc.fill_null(pc.index_in(found, value_set=said), -1).to_numpy()
        for phrase, label in spoken:
            last = len(phrase) - 1
            at = np.flatnonzero(code[: len(code) - last] == code_of[phrase[0]])
            for k in range(1, last + 1):
                at = at[code[at + k] == code_of[phrase[k]]]
            at = at[doc[at] == doc[at + last]]
            yield from ((d, p, label) for d, p in zip(doc[at].tolist(), place[at].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                found, sizes = cut(batch.column(1)[i:j], KEPT)
                doc = np.repeat(np.arange(j - i), sizes)
                place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                starts: list[list[int]] = [[] for _ in sizes]
                base: list[set[str]] = [set() for _ in sizes]
                for d, p, label in places(found, doc, place):
                    starts[d].append(p)
                    base[d].add(label)
                code = pc.index_in(found, value_set=tokens)
                at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                blocks: list[list[dict]] = [[] for _ in sizes]
                for s, d, first, ranks in index.blocks(code.drop_null().to_numpy().astype(np.int64), doc[at], place[at]):
                    for k, part in zip(d.tolist(), np.split(ranks, first[1:]), strict=True):
                        if len(part) >= index.least[s]:
                            blocks[k].append({"stride": s, "ranks": part})
                n = [len(x) for x in starts]
                ends = [[f(x) if x else None for x in starts] for f in (min, max)]
                block = pa.list_(pa.struct([("stride", pa.int32()), ("ranks", pa.list_(pa.int32()))]))
                columns = [batch.column(0)[i:j], pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), *(pa.array(e, pa.int64()) for e in ends), pa.array([sorted(x) for x in base], pa.list_(pa.string())), pa.array(blocks, block)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(run, kinds)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "license-blocks")


def joined(rows: DataFrame, index: Index) -> DataFrame:
    """row, label, containment of every block that meets a template."""
    least = F.lit(0)
    for s, o in index.least.items():
        least = F.when(F.col("block.stride") == s, o).otherwise(least)
    b = F.size("block.ranks")
    blocks = rows.select("row", F.explode("blocks").alias("block")).where(b >= least)
    heads = blocks.select("row", "block.stride", F.col("block.ranks").alias("held"), F.posexplode(F.slice("block.ranks", F.lit(1), b - least + 1)).alias("j", "rank"))
    prefixes = index.prefixes(rows.sparkSession)
    found = heads.join(F.broadcast(prefixes) if sum(len(r[2]) - r[3] + 1 for r in index.rows) <= FEW_PREFIXES else prefixes, ["stride", "rank"])
    found = found.where((F.size("held") >= F.col("needed")) & (F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) >= F.col("needed")))
    common = F.array_intersect("ranks", "held")  # in order of rank
    found = found.withColumn("common", common).where((F.size("common") >= F.col("needed")) & (F.col("common")[0] == F.col("rank")))
    return found.select("row", "label", (F.size("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels), found (labels by templates), score.

    The score is 1 where a phrase stands, else the greatest containment of a template that is found, else 0.
    """
    tokens = sorted({w for _, t in templates for w in words(t)})
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"the templates have {len(tokens)} words; a scan takes {MOST_TOKENS} at most")
    with small_batches(docs.sparkSession):
        index = Index(templates, _counts(docs, tokens), threshold)
        rows = scanned(docs, index, phrases)
    met = joined(rows, index).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    found = F.coalesce("met", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("blocks").join(met, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.sort_array(found).alias("found"), score.alias("score"))


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", names(F.col("base")).alias("base_labels"), names(F.array_union("base", "found")).alias("labels"), "score")
