"""Text expressions: keys, normal forms, snippets, regex helpers.  All are Column expressions; ends are trimmed of any
Unicode white space (not just blanks), and missing counts as empty."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(c), r"(?U)^\s+|\s+$", "")


def text_key(c: Column | str) -> Column:
    """The identity of a text for exact deduplication."""
    return F.lower(strip(c))


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def campaign_form(c: Column | str) -> Column:
    """Lower case, ASCII letters, digits and blanks only (all else is deleted, which may join words), single blanks."""
    return F.trim(F.regexp_replace(family_form(c), " +", " "))


def family_form(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9 ]", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, " +"), lambda w: w != "")


def shingles(tokens: Column, n: int = 5, short_ok: bool = False) -> Column:
    """Distinct runs of ``n`` words; with ``short_ok`` fewer words are one shingle, else none."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))
    whole = F.array(F.array_join(tokens, " ")) if short_ok else F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, runs).otherwise(whole)


def any_match(c: Column, patterns: list[str]) -> Column:
    """True where any pattern is found, whatever the case."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("(?iu)" + p)
    return out


def distinct_matches(c: Column, pattern: str) -> Column:
    """Whole matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit("(?iu)" + pattern), F.lit(0)))


def matching_sentence(c: Column, patterns: list[str]) -> Column:
    """The first sentence that any pattern is found in; empty without one, and for a pattern that isn't valid."""
    try:
        for p in patterns:
            re.compile(p)
    except re.error:
        return F.lit("")
    if not patterns:
        return F.lit("")
    found = F.filter(F.split(text_or_empty(c), r"(?<=[.!?])(?U)\s+"), lambda s: any_match(s, patterns))
    return F.coalesce(strip(F.get(found, F.lit(0))), F.lit(""))


def snippet(c: Column | str, n: int = 70) -> Column:
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.regexp_replace(F.substring(t, 1, n), r"(?U)\s+$", ""), F.lit("…"))).otherwise(t)


def preview(c: Column | str, n: int = 200) -> Column:
    t = text_or_empty(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def clip_at_word(c: Column | str, n: int) -> Column:
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""), F.lit("…"))).otherwise(t)


def head_tail(c: Column | str, head: int, tail: int, marker: str = "\n...\n") -> Column:
    t = text_or_empty(c)
    return F.when(F.length(t) > head + tail, F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail)))).otherwise(t)


def combined_text(body: Column | str, attachment: Column | str, separator: str = "\n\n--- ATTACHMENT CONTENT ---\n") -> Column:
    b, a = text_or_empty(body), text_or_empty(attachment)
    return F.when((strip(b) != "") & (strip(a) != ""), F.concat(b, F.lit(separator), a)).when(strip(b) != "", b).otherwise(a)


def submitter(name: Column, first: Column, last: Column, other: Column) -> Column:
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(blank(name), blank(F.concat_ws(" ", blank(first), blank(last))), blank(other), F.lit(""))


def anonymous(c: Column | str) -> Column:
    t = strip(c)
    return F.when(t.isin("", "Anonymous Anonymous"), F.lit("Anonymous")).otherwise(text_or_empty(c))


def tag_value(c: Column, prefix: str) -> Column:
    """What follows ``prefix:`` and blanks, else the text itself."""
    return F.regexp_replace(c, f"^{prefix}: ?", "")


#: fixed pattern: a body that only points to its attachment
STUB = r"^\s*(\[draft\]\s*)?(please\s+)?see\s+(the\s+)?attach"


def label_text(body: Column | str, attachment: Column | str) -> Column:
    """What stands for a campaign member: the attachment where the body only points to it or has under 12 words."""
    b, a = strip(body), strip(attachment)
    stub = b.rlike("(?iu)" + STUB)
    short = F.size(F.filter(F.split(b, r"(?U)\s+"), lambda w: w != "")) < 12
    return F.when((a != "") & (stub | short), a).when(b != "", b).otherwise(a)


def gibberish(c: Column | str) -> Column:
    """Text that a failed extraction leaves: too short, control characters, unprintable, hardly a letter."""
    t = text_or_empty(c)
    n = F.length(t)
    less = lambda pattern: n - F.length(F.regexp_replace(t, pattern, ""))
    control, letters = less(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), less(r"\p{L}")
    unprintable = less(r"[\p{C}\p{Z}&&[^ \t\n\r]]")
    return F.when(F.length(strip(t)) < 10, True).otherwise((control / n > 0.02) | ((n - unprintable) / n < 0.8) | (letters / n < 0.1))


def iso_date(c: Column | str) -> Column:
    """The day of an ISO time with or without seconds, else the first ten characters."""
    t = text_or_empty(c)
    day = F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mmX")))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.substring(t, 1, 10))


def cell(c: Column, kind: str) -> Column:
    """A value as one cell of a flat file: lists joined by `` | ``, records as JSON, missing as empty."""
    if kind.startswith("array"):
        c = F.array_join(c.cast("array<string>"), " | ")
    elif kind.startswith(("struct", "map")):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(""))


# --- names, on the driver -------------------------------------------------------------------------------------------

#: fixed value: words that stay small in a label unless they come first
SMALL_WORDS = frozenset({"a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"})


def flag_label(key: str, label: str | None = None) -> str:
    """The label given, else the key without its verb as a title: ``mentions_rate_of_pay`` is ``Rate of Pay``."""
    if label:
        return label
    first, *rest = (w.capitalize() for w in re.sub("^(?:mentions|cites)_", "", key).split("_"))
    small = {w.capitalize(): w for w in SMALL_WORDS}
    return " ".join([first, *(small.get(w, w) for w in rest)]) or key


def slug(name: str) -> str:
    """A name as part of a column name: lower case, ``_`` for all that is no ASCII letter or digit."""
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def rgb(colour: str, fallback: str = "0, 0, 0") -> str:
    h = (colour or "").lstrip("#")
    try:
        return ", ".join(str(int(h[i : i + 2], 16)) for i in (0, 2, 4)) if len(h) == 6 else fallback
    except ValueError:
        return fallback
