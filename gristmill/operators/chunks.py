"""Rows in order cut into chunks of at most so many bytes, by maps of blocks that are composed in a tree.

Where a chunk ends depends on all that comes before.  What a block of rows does to the chunk that it finds begun depends on
one number, the bytes that are left in it, and as a function of that number it has steps: a ``ChunkMap``.  Maps compose, and
composition is associative, so they are composed up a tree of ``FAN`` branches; the start of each block then comes down the
same tree, and each block fills its own chunks.  A task reads ``FAN`` maps or the sizes of one block, however many rows
there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.storage import discard, materialize

FAN, BLOCK = 32, 1 << 16


@dataclass(frozen=True)
class ChunkMap:
    """A block of ``total`` bytes.  A begun chunk with room for all of it just goes on.

    Else, with room for ``room[i]`` bytes or more (and less than ``room[i + 1]``), the block begins ``add[i]`` chunks and leaves
    ``left[i]`` bytes in the last one.
    """

    total: int
    room: np.ndarray
    add: np.ndarray
    left: np.ndarray

    def after(self, used: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks begun, and bytes in the last one, for chunks that are found with so many bytes in them."""
        at = np.searchsorted(self.room, np.maximum(cap - used, 0), "right") - 1
        fits = used + self.total <= cap
        return np.where(fits, 0, self.add[at]), np.where(fits, used + self.total, self.left[at])

    def then(self, other: ChunkMap, cap: int) -> ChunkMap:
        more, left = other.after(self.left, cap)
        late = other.room + self.total  # room for all of this block, and some of the other
        kept = late <= cap
        return _stepped(self.total + other.total, np.concatenate([self.room, late[kept]]), np.concatenate([self.add + more, other.add[kept]]), np.concatenate([left, other.left[kept]]))


def _stepped(total: int, room: np.ndarray, add: np.ndarray, left: np.ndarray) -> ChunkMap:
    new = np.concatenate([[True], (add[1:] != add[:-1]) | (left[1:] != left[:-1])])
    return ChunkMap(total, room[new], add[new], left[new])


def _next_begun(ends: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """For each row, the first that no longer fits in a chunk begun at it."""
    return np.maximum(np.searchsorted(ends, ends - sizes + cap, "right"), np.arange(len(sizes)) + 1)


def map_of(sizes: np.ndarray, cap: int) -> ChunkMap:
    n, ends = len(sizes), np.cumsum(sizes)
    nxt = _next_begun(ends, sizes, cap)
    last, count = np.where(nxt < n, nxt, np.arange(n)), (nxt < n).astype(np.int64)
    while True:  # each round doubles how many chunks a step goes on
        further = count[last]
        if not further.any():
            break
        count, last = count + further, last[last]
    first = np.arange(min(int(np.searchsorted(ends, cap, "right")) + 1, n))  # a begun chunk ends at one of these rows
    return _stepped(int(ends[-1]), (ends - sizes)[first], 1 + count[first], int(ends[-1]) - (ends - sizes)[last[first]])


def begins(sizes: np.ndarray, used: int, cap: int) -> np.ndarray:
    """1 for rows that begin a chunk, 0 for others, where the chunk that is found has so many bytes."""
    ends = np.cumsum(sizes)
    nxt, out = _next_begun(ends, sizes, cap), np.zeros(len(sizes), np.int64)
    at = int(np.searchsorted(ends, max(cap - used, 0), "right"))
    while at < len(sizes):
        out[at] = 1
        at = int(nxt[at])
    return out


_MAP = "k long, total long, room array<long>, add array<long>, left array<long>"


def _row(k: int, m: ChunkMap) -> pd.DataFrame:
    return pd.DataFrame({"k": [k], "total": [m.total], "room": [m.room], "add": [m.add], "left": [m.left]})


def _maps(part: pd.DataFrame) -> list[ChunkMap]:
    return [ChunkMap(int(r.total), *(np.asarray(x, np.int64) for x in (r.room, r.add, r.left))) for r in part.itertuples()]


def byte_chunks(rows: DataFrame, line: str, order: str, cap: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Adds chunk: rows in order fill chunks of at most ``cap`` bytes, a line's end included (a longer row has one alone).

    ``order`` is an integer of which rows have one each.  An empty table gives an empty result.
    """
    sizes = rows.select(F.col(order).cast("long").alias("o"), (F.coalesce(F.octet_length(line), F.lit(0)).cast("long") + 1).alias("b"))
    sizes = materialize(sizes.withColumn("k", F.floor(F.col("o") / block)), "chunk-sizes")

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return _row(part["k"].iloc[0], map_of(part.sort_values("o")["b"].to_numpy(), cap))

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        first, *others = _maps(part.sort_values("k"))
        for m in others:
            first = first.then(m, cap)
        return _row(part["p"].iloc[0], first)

    def started(part: pd.DataFrame) -> pd.DataFrame:
        """The children of a node, from its start: the number of the chunk that each finds, and the bytes in it."""
        part = part.sort_values("k")
        chunk, used, out = int(part["chunk"].iloc[0]), int(part["used"].iloc[0]), []
        for k, m in zip(part["k"], _maps(part), strict=True):
            out.append((k, chunk, used))
            more, left = m.after(np.array([used]), cap)
            chunk, used = chunk + int(more[0]), int(left[0])
        return pd.DataFrame(out, columns=["k", "chunk", "used"])

    def filled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o")
        return pd.DataFrame({"o": part["o"], "chunk": part["chunk"] + np.cumsum(begins(part["b"].to_numpy(), int(part["used"].iloc[0]), cap))})

    parent = F.floor(F.col("k") / fan).alias("p")
    levels = [materialize(sizes.groupBy("k").applyInPandas(summed, _MAP), "chunk-maps")]
    while levels[-1].count() > fan:
        levels.append(materialize(levels[-1].select("*", parent).groupBy("p").applyInPandas(composed, _MAP), "chunk-maps"))
    # before the first row stands a chunk with the number -1 that is full; the last level's maps are few enough for one task
    first = [F.lit(-1).cast("long").alias("chunk"), F.lit(cap).cast("long").alias("used")]
    told = levels[-1].select("*", F.lit(0).alias("p"), *first)
    for level in [*reversed(levels[:-1]), None]:
        starts = materialize(told.groupBy("p").applyInPandas(started, "k long, chunk long, used long"), "chunk-starts")
        if level is not None:
            told = level.select("*", parent).join(starts.withColumnRenamed("k", "p"), "p")
    discard(*levels)
    told = sizes.join(starts, "k").groupBy("k").applyInPandas(filled, "o long, chunk int")
    return rows.join(told.withColumnRenamed("o", "_o"), rows[order] == F.col("_o")).drop("_o")
