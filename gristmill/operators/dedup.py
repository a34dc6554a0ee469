"""Exact duplicates: groups, one analysis for all of a group, and what in it belongs to one member only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import text_key, text_or_empty
from gristmill.operators.skew import lookup
from gristmill.storage import materialize


def text_print(c: Column | str = "text_key") -> Column:
    """What stands for a key in shuffles: 256 bits, so that whole texts stay where they are."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def prints(comments: DataFrame) -> DataFrame:
    """row_idx, text_print of every comment, stored: what groups, representatives and members are found by, without any text."""
    return materialize(comments.select("row_idx", text_print(text_key("text")).alias("text_print")), "text-prints")


def groups(comments: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """text_print, total_count, is_unique, duplication_ratio, rep (the first row_idx) of every distinct text.

    Counts are combined before the shuffle, so a hot text is one row per task; ``members`` has who is in a group.  ``keyed``, here
    and below: the stored ``prints`` of the comments, where there are any.
    """
    keyed = comments.select("row_idx", text_print(text_key("text")).alias("text_print")) if keyed is None else keyed
    total = keyed.agg(F.count(F.lit(1)).alias("_all"))  # one row
    out = keyed.groupBy("text_print").agg(F.count(F.lit(1)).alias("total_count"), F.min("row_idx").alias("rep"))
    share = F.concat(F.lit("1/"), F.floor(F.col("_all") / F.col("total_count")).cast("string"))
    return out.crossJoin(F.broadcast(total)).select("text_print", "total_count", (F.col("total_count") == 1).alias("is_unique"), share.alias("duplication_ratio"), "rep")


def members(comments: DataFrame) -> DataFrame:
    """row_idx, id, rep, total_count of every comment: its group by the group's first row.  A hot text is dealt to many tasks."""
    keyed = materialize(comments.select("row_idx", "id", text_print(text_key("text")).alias("text_print")), "text-prints")
    return lookup(keyed, groups(comments, keyed).select("text_print", "rep", "total_count"), ["text_print"], "row_idx").select("row_idx", "id", "rep", "total_count")


def representatives(comments: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """The first row of every distinct text, with its key and count."""
    first = groups(comments, keyed).select(F.col("rep").alias("row_idx"), "total_count")
    return comments.join(first, "row_idx").withColumn("text_key", text_key("text"))


def spread(comments: DataFrame, analysed: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """Give every comment the analysis of its text, null without one.

    The analyses find their rows by prints alone, a hot text in many tasks; the comments then take them by row.
    """
    keyed = prints(comments) if keyed is None else keyed
    told = lookup(keyed, analysed.select(text_print().alias("text_print"), "analysis"), ["text_print"], "row_idx").select("row_idx", "analysis")
    return comments.drop("analysis").join(told, "row_idx", "left").withColumn("text_key", text_key("text"))


def contains_quote(quote: Column, source: Column) -> Column:
    """The native part of quote validation: no quote is valid, no source is not, else plain containment."""
    q, s = F.lower(F.regexp_replace(text_or_empty(quote), r"(?U)^\s+|\s+$", "")), F.lower(text_or_empty(source))
    return F.when(F.length(text_or_empty(quote)) == 0, True).when(F.length(s) == 0, False).otherwise(s.contains(q))


class Runs:
    """All runs of characters of one text, as a suffix automaton: the longest one that another text shares, in one pass over it."""

    def __init__(self, text: str):
        self.steps: list[dict[str, int]] = [{}]
        self.back, self.length = [-1], [0]
        last = 0
        for ch in text:
            new = self._state({}, self.length[last] + 1)
            at = last
            while at >= 0 and ch not in self.steps[at]:
                self.steps[at][ch] = new
                at = self.back[at]
            if at < 0:
                self.back[new] = 0
            else:
                to = self.steps[at][ch]
                if self.length[to] != self.length[at] + 1:
                    twin = self._state(dict(self.steps[to]), self.length[at] + 1)
                    self.back[twin], self.back[to] = self.back[to], twin
                    while at >= 0 and self.steps[at].get(ch) == to:
                        self.steps[at][ch] = twin
                        at = self.back[at]
                    to = twin
                self.back[new] = to
            last = new

    def _state(self, steps: dict[str, int], length: int) -> int:
        self.steps.append(steps)
        self.back.append(0)
        self.length.append(length)
        return len(self.steps) - 1

    def longest_in(self, text: str) -> int:
        best = at = run = 0
        for ch in text:
            while at and ch not in self.steps[at]:
                at = self.back[at]
                run = self.length[at]
            if ch in self.steps[at]:
                at, run = self.steps[at][ch], run + 1
                best = max(best, run)
        return best


def longest_common(a: str, b: str) -> int:
    """Length of the longest common run; linear in both."""
    return Runs(a).longest_in(b)


def check_quotes(rows: DataFrame, quote: str, source: str, threshold: float = 0.7) -> DataFrame:
    """Adds valid and score (longest common run over the quote's length, 3 places).

    Only what plain containment doesn't settle is compared; equal quotes of a batch share their automaton.
    """
    q, s = F.lower(F.regexp_replace(text_or_empty(quote), r"(?U)^\s+|\s+$", "")), F.lower(text_or_empty(source))
    easy = contains_quote(F.col(quote), F.col(source)) | (F.length(s) == 0)
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Runs] = {}
        for b in batches:
            shares = []
            for quote_, source_ in zip(b.column("_q").to_pylist(), b.column("_s").to_pylist(), strict=True):
                if quote_ is None or not quote_:
                    shares.append(None)
                    continue
                if quote_ not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[quote_] = Runs(quote_)
                shares.append(known[quote_].longest_in(source_) / len(quote_))
            scores = [None if x is None else round(x, 3) for x in shares]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(shares, pa.float64()), pa.array(scores, pa.float64())], [*names, "_share", "_score"])

    hard = rows.withColumn("_easy", easy).withColumn("_q", F.when(~F.col("_easy"), q)).withColumn("_s", F.when(~F.col("_easy"), s)).drop("_easy")
    told = hard.mapInArrow(compare, f"{kinds}, _share double, _score double")
    valid = contains_quote(F.col(quote), F.col(source))
    score = F.when((F.length(text_or_empty(quote)) > 0) & valid, 1.0).otherwise(0.0)
    return told.withColumn("valid", F.coalesce(F.col("_share") >= threshold, valid)).withColumn("score", F.coalesce("_score", score)).drop("_share", "_score")


#: a quote field and the value it is the evidence for
IDENTITY = {"entity_name": None, "state_quote": "state_identified", "political_affiliation_quote": "political_affiliation"}


def localize(rows: DataFrame, own: Column, size: str = "total_count") -> DataFrame:
    """In groups of several, clear quotes that aren't found in a member's own words, and the values they justify."""
    for quote, value in IDENTITY.items():
        if quote in rows.columns:
            foreign = (F.col(size) > 1) & (text_or_empty(quote) != "") & ~contains_quote(F.col(quote), own)
            rows = rows.withColumn("_f", foreign)
            if value:
                rows = rows.withColumn(value, F.when(F.col("_f"), "").otherwise(F.col(value)))
            rows = rows.withColumn(quote, F.when(F.col("_f"), "").otherwise(F.col(quote))).drop("_f")
    return rows
