"""Fill-in-middle: texts cut into prefix, middle and suffix at token borders, in an order that a model can learn from.

A token is a maximal run of ASCII letters, or any other code point by itself.  Tokens are never listed: a text is encoded
as its maximal runs of one character class, with the number of units (tokens) before each run.  The run that holds a cut
is found by binary search in those sums, and the place in it by arithmetic: a run of letters is one unit, which starts
where the run does, and in a run of other characters the k-th unit is the k-th code point.

Where a text is cut, and in which form it is given, follow from SHA-256 of the seed and the doc_id, so that any run gives
the same.  The text between the marks is untouched, and texts that hold a mark are left plain, so ``restored`` gives every
text back from output and form alone.

Rows: null text counts as empty; empty texts are plain, with no tokens.  A null doc_id is hashed as the empty string.
Repeated rows get equal results, each row its own; an empty table gives an empty result; other columns are ignored.  Texts
of any length are cut whole: what is held of a text is a few numbers a run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bytewords import slices

MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts, so many are transformed, and of 100 transformed ones so many get the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class Runs:
    """Maximal runs of letters or of other characters: ``start`` (code point) and ``before`` (units) of each, and the ends."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letter = ((codes | 32) - codes.dtype.type(97)) < 26  # unsigned: what is below 'a' wraps round
        self.start = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1]) if len(codes) else np.zeros(0, np.int64)
        self.letters = letter[self.start]
        self.chars = len(codes)
        units = np.where(self.letters, 1, np.diff(self.start, append=self.chars))
        self.before = np.concatenate([[0], np.cumsum(units)])
        self.n = int(self.before[-1])

    def place(self, unit: int) -> int:
        """The code point at which the unit starts; the end of the text for the number of units."""
        if unit >= self.n:
            return self.chars
        run = int(np.searchsorted(self.before, unit, side="right")) - 1
        return int(self.start[run]) + (0 if self.letters[run] else unit - int(self.before[run]))


def draws(doc_id: object, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(docs: DataFrame, seed: int = SEED, marks: tuple[str, str, str] = MARKS, share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    ``marks`` open prefix, suffix and middle.  ``restored`` needs marks that start with a character they don't repeat.
    """
    p, s, m = marks

    def one(doc_id: int | None, text: str) -> tuple:
        runs, (h1, h2, h3, h4) = Runs(text), draws(doc_id, seed)
        if not text or any(x in text for x in marks) or h3 % 100 >= share:
            return runs.n, "plain", None, None, text
        a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
        i, j = runs.place(a), runs.place(b)
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if h4 % 100 < suffix_first:
            return runs.n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return runs.n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, texts = batch.column(0)[i:j], batch.column(1)[i:j]
                rows = [one(d, t) for d, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form."""
    between = "|".join(map(re.escape, marks))
    part = F.split(output, between, -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
