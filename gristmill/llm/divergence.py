"""How the sources of a language differ in their words: a divergence of every pair of sources, and the terms each overuses.

For two groups (language and source) with smoothed shares p and q, a term adds (p - q)^2 / q, in integers.  All pairs of a
language's groups are computed in tiles:

1. Every task counts the terms of its texts by group, slice by slice, so that a group with a third of all rows is summed
   before it is shuffled.  Terms in fewer than ``LEAST_DOCS`` documents of a language go.
2. A language's vocabulary is dealt to chunks of about ``CHUNK`` terms by hash, each term with a position in its chunk.  What
   a group counts in a chunk is packed into one row: two arrays, positions and counts.
3. Groups come in blocks of ``BLOCK``.  A packed row is replicated to the tiles of its block with every block of the language.
   A task has one tile and a run of chunks, goes over these one after the other with one chunk in memory, and adds up the
   submatrix of pairs.  Terms that no group of a tile has in a chunk add a constant for each pair, which is only multiplied.

No two groups are ever joined as rows, and no task sees all terms or all groups.

Arithmetic is exact: integers of 64 bits, or of any size where counts pass ``WIDE``.

Rows: null text, lang and source count as empty strings, which are a language and a source of their own.  Each row is a
document, so repeated rows count as often as they come.  Groups without terms have pairs as well.  Ties in value go by the
item's UTF-8 bytes.  An empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.bytewords import LETTERS, cut, slices, table
from gristmill.operators.skew import lookup
from gristmill.storage import materialize, small_batches

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Terms of a chunk, groups of a block, chunks that one task goes over.
CHUNK, BLOCK, RUN = 1 << 14, 16, 8
#: Rows of texts and of packed counts that go to Python at once.
TEXT_ROWS, PACKED_ROWS = 1000, 64
#: Counts below this stay within 64 bits when they are scaled.
WIDE = 9_000_000_000
#: Rows of a table of groups that is sent to all tasks; a longer one is joined.
FEW_GROUPS = 10_000


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of each slice of rows; a row with a null term for each of its groups."""
    kept = table(LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                terms, sizes = cut(batch.column(2)[i:j], kept)
                groups: dict[tuple[str, str], int] = {}
                group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist(), strict=True)], np.int64)
                coded = terms.dictionary_encode()
                v, code = len(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
                cells, n = np.unique(np.repeat(group, sizes) * v + code, return_counts=True)
                seen = np.unique(np.repeat(np.arange(j - i), sizes) * v + code)  # a document's terms, once each
                _, in_docs = np.unique(group[seen // max(v, 1)] * v + seen % max(v, 1), return_counts=True)  # the same cells
                at = pa.array(np.concatenate([cells // max(v, 1), np.arange(len(groups))]), pa.int64())
                names = [pa.array([g[k] for g in groups], pa.string()).take(at) for k in (0, 1)]
                nothing = np.zeros(len(groups), np.int64)
                term = pa.concat_arrays([coded.dictionary.take(pa.array(cells % max(v, 1))), pa.nulls(len(groups), pa.string())])
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(np.concatenate([n, nothing])), pa.array(np.concatenate([in_docs, nothing]))], ["lang", "source", "term", "n", "docs"])

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*plain).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, total (n in the language), first (of a term's rows); null terms stand for groups as such; stored."""
    cells = counted(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")  # a row a source
    cells = cells.withColumns({"in_docs": F.sum("docs").over(every), "total": F.sum("n").over(every), "first": F.col("source") == F.min("source").over(every)})
    with small_batches(docs.sparkSession, TEXT_ROWS):
        return materialize(cells.where((F.col("in_docs") >= least_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "total", "first"), "divergence-cells")


def groups_of(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, words (count + vocabulary), lang_words (the same of the language), vocabulary, block, blocks; stored."""
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("vocabulary"))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("own")).join(langs, "lang")
    # all groups of a language in order: as many as the pairs' rows for a single one of them
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    blocks = (F.floor((size - 1) / block) + 1).cast("int").alias("blocks")
    words = [(F.col(c) + F.col("vocabulary")).alias(name) for c, name in (("own", "words"), ("lang_n", "lang_words"))]
    return materialize(groups.select("lang", "source", *words, "vocabulary", F.floor(place / block).cast("int").alias("block"), blocks), "divergence-groups")


def _with_groups(rows: DataFrame, groups: DataFrame, few: bool, by: str) -> DataFrame:
    return rows.join(F.broadcast(groups), ["lang", "source"]) if few else lookup(rows, groups, ["lang", "source"], by)


def share(n: Column, words: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / words)."""
    wide = (n + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(n + 1 < WIDE, _div(F.lit(SCALE) * (n + 1), words)).otherwise(_div(wide.cast("decimal(38,0)"), words.cast("decimal(38,0)"))) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(n: np.ndarray, words: int) -> np.ndarray:
    if len(n) and int(n.max()) + 1 >= WIDE:
        return np.array([1 + SCALE * (int(x) + 1) // words for x in n], np.int64)
    return 1 + (n + 1) * SCALE // words


class Tile:
    """The submatrix of pairs between two blocks of groups, added up chunk by chunk."""

    def __init__(self, headers: list[tuple[str, int, int, int]], i: int, j: int, with_constant: bool):
        """``headers``: source, words, vocabulary, block of each group."""
        self.names = [[h[0] for h in headers if h[3] == b] for b in (i, j)]
        self.words = [{h[0]: h[1] for h in headers if h[3] == b} for b in (i, j)]
        self.none = [np.array([int(shares(np.zeros(1, np.int64), w)[0]) for w in ws.values()], np.int64) for ws in self.words]
        d = self.none[0][:, None] - self.none[1][None, :]
        self.constant = (d * d // self.none[1][None, :], d.T * d.T // self.none[0][None, :])  # of a term that neither group has
        absent = headers[0][2] if with_constant else 0
        self.sums = [c.astype(object) * absent for c in self.constant]
        self.same = i == j

    def add(self, packed: list[tuple[int, str, np.ndarray, np.ndarray]], blocks: tuple[int, int]) -> None:
        """One chunk: block, source, positions and counts of the groups that have any of its terms."""
        active = np.unique(np.concatenate([p[2] for p in packed]))
        sides = []
        for k in (0, 1):
            side = np.repeat(self.none[k][:, None], len(active), axis=1)
            for block, source, pos, n in packed:
                if block == blocks[k]:
                    side[self.names[k].index(source), np.searchsorted(active, pos)] = shares(n, self.words[k][source])
            sides.append(side)
        a, b = sides
        for g in range(len(a)):
            d = a[g] - b
            d *= d
            self.sums[0][g] += (d // b).sum(axis=1) - len(active) * self.constant[0][g]
            if not self.same:
                self.sums[1][:, g] += (d // a[g]).sum(axis=1) - len(active) * self.constant[1][:, g]

    def rows(self) -> Iterator[tuple[str, str, int]]:
        for k in (0,) if self.same else (0, 1):
            for g, source in enumerate(self.names[k]):
                for h, item in enumerate(self.names[1 - k]):
                    if not (self.same and g == h):
                        yield source, item, int(self.sums[k][g][h])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile, run and chunk; the headers of a tile, chunk -1, before its packed rows."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("lang", "i", "j", "run", "chunk", "block", "source", "words", "vocabulary")]
            for k, row in enumerate(zip(*plain, strict=True)):
                yield *row, batch.column("pos")[k].values.to_numpy(), batch.column("n")[k].values.to_numpy()

    def done(lang: str, tile: Tile | None) -> Iterator[pa.RecordBatch]:
        if tile and (found := list(tile.rows())):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), *(pa.array(v) for v in zip(*found, strict=True))], ["lang", "source", "item", "value"])

    key = tile = chunk = None
    headers: list[tuple] = []
    packed: list[tuple] = []

    def flush() -> None:
        nonlocal tile
        if tile is None and headers:
            tile = Tile(headers, key[1], key[2], key[3] == 0)
        if packed:
            tile.add(packed, (key[1], key[2]))
            packed.clear()

    for lang, i, j, run, at, block, source, words, vocabulary, pos, n in rows():
        if key != (lang, i, j, run):
            if key:
                flush()
                yield from done(key[0], tile)
            key, tile, chunk = (lang, i, j, run), None, -1
            headers.clear()
        if at != chunk:
            flush()
            chunk = at
        if at < 0:
            headers.append((source, words, vocabulary, block))
        else:
            packed.append((block, source, pos, n))
    if key:
        flush()
        yield from done(key[0], tile)


def pairs(cells: DataFrame, groups: DataFrame, few: bool, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """lang, source, item (another source), value of all pairs, stored."""
    terms = cells.where("term is not null")
    chunks = max(1, -(-terms.where("first").count() // chunk))
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    placed = terms.withColumn("pos", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    # at most a chunk's terms in a row
    packed = placed.groupBy("lang", "chunk", "source").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("cells"))
    packed = packed.select("lang", "chunk", "source", F.floor(F.col("chunk") / run).cast("int").alias("run"), F.col("cells.pos").alias("pos"), F.col("cells.n").alias("n"))
    packed = _with_groups(packed, groups, few, "chunk")
    runs = F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // run)))
    headers = groups.withColumn("run", runs).withColumns({"chunk": F.lit(-1), "pos": F.array().cast("array<int>"), "n": F.array().cast("array<long>")})
    names = ["lang", "run", "chunk", "block", "blocks", "source", "words", "vocabulary", "pos", "n"]
    sent = headers.select(names).unionByName(packed.select(names)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    tile = ["lang", "i", "j", "run"]
    sent = sent.select(*tile, "chunk", "block", "source", "words", "vocabulary", "pos", "n").repartition(*tile).sortWithinPartitions(*tile, "chunk", "block", "source")
    parts = sent.mapInArrow(_tiles, "lang string, source string, item string, value long")
    with small_batches(cells.sparkSession, PACKED_ROWS):
        return materialize(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "divergence-pairs")


def overused(cells: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """lang, source, item (a term whose share in the group is above the language's), value."""
    rows = _with_groups(cells.where("term is not null and n > 0"), groups, few, "term")
    rows = rows.withColumns({"p": share(F.col("n"), F.col("words")), "q": share(F.col("total"), F.col("lang_words"))}).where("p > q")
    d = F.col("p") - F.col("q")
    return rows.select("lang", "source", F.col("term").alias("item"), _div(d * d, F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """lang, source, part (``pair``: all other sources; ``term``: the ``top`` overused terms), item, value, rank."""
    cells = kept_terms(docs, least_docs)
    groups = groups_of(cells, block)
    few = groups.count() <= FEW_GROUPS
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, rows: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked("pair", pairs(cells, groups, few, chunk, run)).unionByName(ranked("term", overused(cells, groups, few)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
