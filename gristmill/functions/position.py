"""The buckets that a comment's position falls into.  They answer different questions and differ on purpose.

``analysis`` is a struct with ``stances`` (array of tags such as ``Position: Oppose``) and ``verified_stance``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPPOSE, SUPPORT = "Position: Oppose", "Position: Support"


def tags(analysis: Column) -> Column:
    return F.coalesce(analysis["stances"], F.array().cast("array<string>"))


def _has(analysis: Column, tag: str) -> Column:
    return F.exists(tags(analysis), lambda s: s.contains(tag))


def _first(analysis: Column) -> Column:
    first = F.get(F.filter(tags(analysis), lambda s: s.contains(OPPOSE) | s.contains(SUPPORT)), F.lit(0))
    return F.when(first.contains(OPPOSE), "Oppose").when(first.contains(SUPPORT), "Support").otherwise("Unclear")


def shown(analysis: Column) -> Column:
    """For display: what the second pass verified, else the first position tag."""
    return F.when(analysis["verified_stance"].isin("Oppose", "Support", "Unclear"), analysis["verified_stance"]).otherwise(_first(analysis))


def card(analysis: Column) -> Column:
    """For briefing cards: a verified Unclear wins, else the first position tag."""
    return F.when(analysis["verified_stance"] == "Unclear", F.lit("Unclear")).otherwise(_first(analysis))


def conflict(analysis: Column) -> Column:
    """For conflicts in a reuse cache: Oppose before Support in any order; no list is ''."""
    return F.when(analysis["stances"].isNull(), "").when(_has(analysis, OPPOSE), "Oppose").when(_has(analysis, SUPPORT), "Support").otherwise("other")


def gate(analysis: Column) -> Column:
    """For quality gates: no tag at all is ``none``."""
    return F.when(F.size(tags(analysis)) == 0, "none").when(_has(analysis, OPPOSE), "Oppose").when(_has(analysis, SUPPORT), "Support").otherwise("other")


def population(analysis: Column) -> Column:
    """For accuracy estimates: by the first tag that starts with ``Position:``."""
    first = F.get(F.filter(tags(analysis), lambda s: s.startswith("Position:")), F.lit(0))
    return F.when(first.isNull(), "no_position").when(first.contains("Support"), "support").otherwise("oppose")


def configured(analysis: Column, positions: list[str]) -> Column:
    """For evaluation sets: the first tag that is a configured position."""
    return F.coalesce(F.get(F.filter(tags(analysis), lambda s: s.isin(positions)), F.lit(0)), F.lit("(none)"))
