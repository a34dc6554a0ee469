"""Filters of a result table, between a query string, a small tree, and a Column."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FilterSpec:
    """How each parameter filters: ``one_of`` a column, ``any_of`` an array, ``contains`` text, ``dates`` (from..to), ``flag`` (Yes or No)."""

    kinds: dict[str, tuple[str, str]]  # parameter -> (kind, column)


def parse(query: str, spec: FilterSpec) -> dict[str, list[str]]:
    """Parameters that the spec knows; a reversed date range is turned round."""
    out = {k: [v for v in vs if v] for k, vs in parse_qs(query.lstrip("?"), keep_blank_values=True).items() if k in spec.kinds}
    for k, vs in out.items():
        if spec.kinds[k][0] == "dates" and vs:
            a, _, b = vs[0].partition("..")
            if ".." not in vs[0]:
                b = a
            out[k] = ["..".join((b, a) if a and b and a > b else (a, b))]
    return {k: vs for k, vs in out.items() if vs}


def to_query(state: dict[str, list[str]]) -> str:
    return urlencode(sorted(state.items()), doseq=True)


def predicate(state: dict[str, list[str]], spec: FilterSpec) -> Column:
    """Values of one parameter are alternatives; parameters must all hold."""
    out = F.lit(True)
    for k, vs in state.items():
        kind, name = spec.kinds[k]
        c = F.col(name)
        if kind == "one_of":
            test = c.isin(vs)
        elif kind == "any_of":
            test = F.arrays_overlap(c, F.array(*map(F.lit, vs)))
        elif kind == "contains":
            test = F.lower(c).contains(vs[0].lower())
        elif kind == "flag":
            test = F.coalesce(c, F.lit(False)) == (vs[0].lower() == "yes")
        else:
            a, _, b = vs[0].partition("..")
            test = (c >= a if a else F.lit(True)) & (c <= b if b else F.lit(True))
        out = out & F.coalesce(test, F.lit(False))
    return out
