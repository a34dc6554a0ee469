"""Wide exports: every analysed comment with the source row it came from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gristmill.functions.text import cell, distinct_matches, slug, strip, text_or_empty
from gristmill.operators.skew import nth
from gristmill.storage import materialize


class Unmatched(RuntimeError):
    """Comments that no source row belongs to: the source is older than the analysis."""


def match_source(comments: DataFrame, source: DataFrame) -> DataFrame:
    """row_idx, src_idx, same_text: each comment with a source row of its own, stored.

    ``comments``: row_idx, id, text; ``source``: src_idx, id, tracking, text.  The part of an id after ``#`` names a tracking
    number; then equal texts pair up, n-th with n-th; then what is left of an id, in input order.  Texts are compared by
    their MD5, so that only keys are shuffled.
    """
    c = comments.select("row_idx", F.substring_index("id", "#", 1).alias("base"), F.when(F.col("id").contains("#"), F.regexp_extract("id", "#(.*)$", 1)).alias("suffix"), F.md5(strip("text")).alias("t"))
    s = source.select("src_idx", strip("id").alias("base"), strip("tracking").alias("suffix"), F.md5(strip("text")).alias("t"))
    c0, s0 = materialize(c, "match-comments"), materialize(s, "match-source")
    c, s, found = c0, s0, []

    def pair(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        x, y = nth(a, keys, "row_idx", "_n"), nth(b, keys, "src_idx", "_n")
        return x.join(y.select(*keys, "_n", "src_idx"), [*keys, "_n"]).select("row_idx", "src_idx")

    for keys in (["base", "suffix"], ["base", "t"], ["base"]):
        now = materialize(pair(c.where("suffix is not null") if "suffix" in keys else c, s, keys), "matched")
        c, s = c.join(now, "row_idx", "left_anti"), s.join(now, "src_idx", "left_anti")
        found.append(now)
    out = found[0].unionByName(found[1]).unionByName(found[2])
    texts = out.join(c0.select("row_idx", F.col("t").alias("ct")), "row_idx").join(s0.select("src_idx", F.col("t").alias("st")), "src_idx")
    return materialize(texts.select("row_idx", "src_idx", (F.col("ct") == F.col("st")).alias("same_text")), "matched")


def check_matched(comments: DataFrame, matched: DataFrame) -> int:
    """How many matched rows differ in text; ``Unmatched`` if a comment has no row."""
    lost = comments.select("row_idx", "id").join(matched, "row_idx", "left_anti")
    if n := lost.count():
        first = [r["id"] for r in lost.orderBy("row_idx").limit(5).collect()]
        raise Unmatched(f"{n} comments have no source row, first {', '.join(first)}")
    return matched.where("not same_text").count()


def flat(c: Column, kind: DataType) -> Column:
    """A value as one cell: records and maps as JSON with sorted keys, truth as True or False, others as ``cell`` has them."""
    if isinstance(kind, StructType) and kind.fields:
        return F.when(c.isNotNull(), F.to_json(F.struct(*[c[n].alias(n) for n in sorted(kind.names)]))).otherwise("")
    if isinstance(kind, MapType):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit(""))
    if kind.simpleString() == "boolean":
        return F.coalesce(F.when(c, "True").otherwise("False"), F.lit(""))
    return cell(c, "array" if isinstance(kind, ArrayType) else kind.simpleString())


def option_columns(analysis: Column, kinds: StructType, options: dict[str, Iterable[str]]) -> dict[str, Column]:
    """A truth column for each option of each field: whether its list has it, or its value is it."""
    has = lambda n, o: F.array_contains(analysis[n], o) if isinstance(kinds[n].dataType, ArrayType) else analysis[n] == o
    return {f"{n}__{slug(o)}": F.coalesce(has(n, o), F.lit(False)) for n, os in options.items() for o in os}


def value_columns(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    return {f"{n}_values": distinct_matches(text, p) for n, p in patterns.items()}


def _named(derived: dict[str, Column], source_columns: Iterable[str]) -> dict[str, Column]:
    """The derived columns under names fit for a flat file; names that clash with each other or with the source are errors."""
    names = [n if n.isidentifier() else slug(n) for n in derived]
    low = [n.lower() for n in names]
    if clash := sorted({n for n in low if low.count(n) > 1} | (set(low) & {n.lower() for n in source_columns})):
        raise ValueError(f"derived columns clash: {', '.join(clash)}")
    return dict(zip(names, derived.values(), strict=True))


def _cells(rows: DataFrame, named: dict[str, Column]) -> list[Column]:
    kinds = rows.select(*[c.alias(n) for n, c in named.items()]).schema
    return [flat(c, kinds[n].dataType).alias(n) for n, c in named.items()]


def wide(rows: DataFrame, derived: dict[str, Column], source_columns: list[str]) -> DataFrame:
    """Source columns, then derived ones as flat cells."""
    return rows.select(*[F.col(f"`{n}`") for n in source_columns], *_cells(rows, _named(derived, source_columns)))


def full_export(comments: DataFrame, source: DataFrame, derived: dict[str, Column], keys: dict[str, str]) -> DataFrame:
    """One row a comment: every column of its source row, then the derived ones over the comment.

    ``source`` has src_idx beside its own columns; ``keys`` names those that hold its id, tracking number and text.
    """
    columns = [n for n in source.columns if n != "src_idx"]
    named = source.select("src_idx", *[text_or_empty(F.col(f"`{keys[k]}`")).alias(k) for k in ("id", "tracking", "text")])
    matched = match_source(comments.select("row_idx", "id", "text"), named)
    check_matched(comments, matched)
    rows = source.select("src_idx", F.struct(*[F.col(f"`{n}`") for n in columns]).alias("_source"))
    joined = comments.join(matched.select("row_idx", "src_idx"), "row_idx").join(rows, "src_idx")
    cells = _cells(joined, _named(derived, columns))
    return joined.orderBy("row_idx").select(*[F.col(f"_source.`{n}`") for n in columns], *cells)
