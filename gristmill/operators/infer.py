"""Classification of distinct texts, its reuse between runs, and the second pass.

A classifier is anything with ``classify(df) -> df`` that adds ``analysis``; one made of expressions and one that replays
recorded answers are here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import position
from gristmill.functions.text import any_match, strip, text_key, text_or_empty


@dataclass
class RuleClassifier:
    """Tags by patterns: ``tags`` maps a tag to its patterns, ``entity`` a type to its; the first entity that fits wins."""

    tags: dict[str, list[str]]
    entity: dict[str, list[str]] = field(default_factory=dict)
    default_entity: str = "Individual"

    def classify(self, rows: DataFrame, text: str = "text") -> DataFrame:
        t = text_or_empty(text)
        found = F.filter(F.array(*[F.when(any_match(t, p), F.lit(tag)) for tag, p in self.tags.items()]), lambda x: x.isNotNull())
        kind = F.lit(self.default_entity)
        for name, patterns in reversed(self.entity.items()):
            kind = F.when(any_match(t, patterns), name).otherwise(kind)
        return rows.withColumn("analysis", F.struct(found.alias("stances"), kind.alias("entity_type"), F.lit(None).cast("string").alias("verified_stance")))


@dataclass
class RecordedClassifier:
    """Answers by text key from a table of earlier responses (text_key, analysis)."""

    answers: DataFrame

    def classify(self, rows: DataFrame, text: str = "text") -> DataFrame:
        keyed = rows.withColumn("_k", text_key(text))
        return keyed.join(self.answers.select(F.col("text_key").alias("_k"), "analysis"), "_k", "left").drop("_k")


def only_known(values: Column, known: list[str]) -> Column:
    """The configured ones of a list, in their order."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda s: s.isin(known))


def known_or(value: Column, known: list[str], default: str = "") -> Column:
    return F.when(value.isin(known), value).otherwise(default)


# fixed values: what a service says when every further call would fail alike, and what stops a publish; compared in lower case
CREDENTIAL_MARKERS = (
    "insufficient_quota", "exceeded your current quota", "billing_hard_limit_reached", "billing hard limit", "invalid_api_key",
    "incorrect api key", "authenticationerror", "no api key provided", "account is not active", "error code: 401",
)
PUBLISH_MARKERS = ("no credits remaining", "ratelimiterror", "insufficient_quota", "exceeded your current quota", "authenticationerror", "invalid api key")


def says_any(error: Column, markers: tuple[str, ...]) -> Column:
    low, found = F.lower(text_or_empty(error)), F.lit(False)
    for m in markers:
        found = found | low.contains(m)
    return found


def credential_errors(rows: DataFrame, error: str = "analysis_error", markers: tuple[str, ...] = PUBLISH_MARKERS) -> DataFrame:
    """Rows whose analysis failed as the account couldn't be used; ``error`` is a service's type and message, as a run logs it."""
    return rows.where(says_any(F.col(error), markers))


# --- reuse ----------------------------------------------------------------------------------------------------------


def reuse_cache(previous: DataFrame) -> DataFrame:
    """text_key and analysis of texts whose earlier analyses agree on the position; the last row's wins.

    Counts of buckets are combined before the shuffle; a text with conflicting buckets is left out, to be done again.
    """
    rows = previous.where("analysis is not null").select("row_idx", text_key("text").alias("text_key"), "analysis", position.conflict(F.col("analysis")).alias("bucket"))
    out = rows.groupBy("text_key").agg(F.min("bucket").alias("b0"), F.max("bucket").alias("b1"), F.max_by("analysis", "row_idx").alias("analysis"))
    return out.where("b0 = b1").select("text_key", "analysis")


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str = "text_key") -> tuple[DataFrame, DataFrame]:
    """Rows that the cache answers, with its analysis, and those to do."""
    return rows.join(cache, key), rows.join(cache, key, "left_anti")


def read_log(lines: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key in an append-only log; entries without a key don't count."""
    return lines.where(text_or_empty(key) != "").groupBy(key).agg(F.max_by(F.struct(*lines.columns), order).alias("r")).select("r.*")


# --- second pass ----------------------------------------------------------------------------------------------------


def stance_trigger(analysis: Column, body: Column, support: bool = True, unclear: bool = True, short_oppose: int | None = None) -> Column:
    tags = position.tags(analysis)
    s, o = F.exists(tags, lambda x: x.contains("Support")), F.exists(tags, lambda x: x.contains("Oppose"))
    fire = (s & F.lit(support)) | (~s & ~o & F.lit(unclear))
    if short_oppose is not None:
        fire = fire | (o & (F.length(strip(body)) < short_oppose))
    return fire & (text_or_empty(analysis["verified_stance"]) == "") & analysis.isNotNull()


def repeated_short_line(text: Column, shortest: int = 4, longest: int = 60) -> Column:
    """A line of middling length that comes again, whatever its case: the shape of a signature block."""
    lines = F.transform(F.split(text_or_empty(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: F.lower(strip(F.regexp_replace(x, "[ \t]+", " "))))
    lines = F.filter(lines, lambda x: (F.length(x) >= shortest) & (F.length(x) <= longest) & ~x.rlike("^[0-9]+$"))
    return F.size(lines) > F.size(F.array_distinct(lines))


def signer_trigger(analysis: Column, text: Column, phrases: list[str]) -> Column:
    """Letters that may have several signers, unless they have been looked at or have no analysis."""
    asked = F.coalesce(analysis["cosigner_checked"], F.lit(False))
    return (any_match(text_or_empty(text), phrases) | repeated_short_line(text)) & ~asked & analysis.isNotNull()


# fixed pattern: what an attorney says of themself, in lower-cased text
SELF_IDENTIFIED = (
    r"i am (?:a |an )?(?:concerned )?(?:citizen[, ]+ (?:and )?(?:a )?)?(?:attorney|lawyer)|as (?:a |an )?(?:former |retired )?(?:attorney|lawyer)"
    r"|licensed (?:attorney|to practice)|member of (?:the |a )?(?:\w+ )?bar|admitted to (?:the |a )?bar|practicing (?:attorney|lawyer)"
    r"|i practice law|law degree|juris doctor|j\.d\.|esq\b|passed the bar|barred in|my license to practice"
    r"|(?:former |retired )?(?:prosecutor|AUSA|assistant u\.?s\.? attorney)|(?:concerned |retired |former )?(?:attorney|lawyer) who"
)
ATTORNEY = "Attorney/Lawyer"


def entity_trigger(analysis: Column, body: Column, types: list[str], attorneys: bool = False) -> Column:
    """Types to look at again, and attorneys who don't say in their text that they are; an empty verified type doesn't count."""
    kind = text_or_empty(analysis["entity_type"])
    fire = kind.isin(types)
    if attorneys:
        fire = fire | ((kind == ATTORNEY) & ~F.lower(text_or_empty(body)).rlike("(?U)" + SELF_IDENTIFIED))
    return fire & (text_or_empty(analysis["verified_entity_type"]) == "") & analysis.isNotNull()


def state_trigger(analysis: Column, text: Column, every: bool = False, mismatch: bool = True) -> Column:
    """States whose quote isn't in the text, or all; an empty verified state counts as verified."""
    quote = F.lower(text_or_empty(analysis["state_quote"]))
    fire = F.lit(every) | (F.lit(mismatch) & (quote != "") & ~F.lower(text_or_empty(text)).contains(quote))
    return fire & (text_or_empty(analysis["state_identified"]) != "") & analysis["verified_state"].isNull() & analysis.isNotNull()


def political_trigger(analysis: Column) -> Column:
    """Every affiliation that isn't verified yet; an empty verified one counts as verified."""
    return (text_or_empty(analysis["political_affiliation"]) != "") & analysis["verified_political"].isNull() & analysis.isNotNull()


@dataclass(frozen=True)
class Verified:
    """The fields of an analysis that a verdict touches; one with a quote can be cleared, and its verdicts are stripped."""

    value: str
    verified: str
    reasoning: str
    quote: str | None = None

    def read(self, verdict: Column) -> Column:
        return strip(verdict) if self.quote else verdict

    def write(self, analysis: Column, verdict: Column, reasoning: Column) -> Column:
        """The analysis after a verdict, null (a failed call) leaves it; it has all the fields named here."""
        new, old = self.read(verdict), analysis
        put = lambda name, x: F.when(verdict.isNotNull(), x).otherwise(old[name])
        out = analysis.withField(self.verified, put(self.verified, new)).withField(self.reasoning, put(self.reasoning, text_or_empty(reasoning))).withField(self.value, put(self.value, new))
        if self.quote:
            out = out.withField(self.quote, F.when(verdict.isNotNull() & (new == "") & ~new.eqNullSafe(old[self.value]), "").otherwise(old[self.quote]))
        return out

    def outcome(self, analysis: Column, verdict: Column) -> Column:
        """error, confirmed, cleared or changed, for an analysis before the verdict is written."""
        new = self.read(verdict)
        out = F.when(verdict.isNull(), "error").when(new.eqNullSafe(analysis[self.value]), "confirmed")
        return (out.when(new == "", "cleared") if self.quote else out).otherwise("changed")


ENTITY = Verified("entity_type", "verified_entity_type", "entity_verification_reasoning")
STATE = Verified("state_identified", "verified_state", "state_verification_reasoning", "state_quote")
POLITICAL = Verified("political_affiliation", "verified_political", "political_verification_reasoning", "political_affiliation_quote")


def outcome_counts(rows: DataFrame, outcomes: dict[str, Column]) -> DataFrame:
    """field, outcome, n; ``outcomes`` are null where nothing was asked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.alias("outcome")) for k, c in outcomes.items()]))
    return rows.select(pairs.alias("r")).select("r.*").where("outcome is not null").groupBy("field", "outcome").agg(F.count(F.lit(1)).alias("n"))


def position_tags(options: list[str]) -> dict[str, str]:
    """The tag that a collection declares for each verdict: its first position that opens with it, else a plain one."""
    found = {v: [o for o in options if o.startswith(f"Position: {v}")] for v in ("Oppose", "Support")}
    return {v: os[0] if os else f"Position: {v}" for v, os in found.items()}


def write_stance(analysis: Column, verdict: Column, options: list[str] = ()) -> Column:
    """The tags after a verdict: position tags go, the verdict's comes first (none for Unclear); null leaves them."""
    kept = F.filter(position.tags(analysis), lambda x: ~x.startswith("Position:"))
    first = F.array().cast("array<string>")
    for v, tag in position_tags(list(options)).items():
        first = F.when(verdict == v, F.array(F.lit(tag))).otherwise(first)
    return F.when(verdict.isNull(), analysis["stances"]).otherwise(F.concat(first, kept))


COSIGNERS = {"cosigner_checked": "boolean", "cosigner_has_flag": "boolean", "cosigner_names": "array<string>", "cosigner_count": "int", "cosigner_reasoning": "string"}


def write_signers(analysis: Column, said: Column, reasoning: Column, names: Column, count: Column) -> Column:
    """The analysis after signers were looked for.  ``said``: whether the model sees any, null where the call failed.

    Names are null where its quotes don't stand in the text.  All that were asked about are marked, so that none is asked again.
    """
    found = F.coalesce(said, F.lit(False))
    placed = found & names.isNotNull()
    out = analysis.withField("cosigner_checked", F.lit(True)).withField("cosigner_has_flag", found)
    out = out.withField("cosigner_names", F.when(placed, names).otherwise(F.array().cast("array<string>"))).withField("cosigner_count", F.when(placed, F.greatest(count, F.lit(1))).otherwise(1).cast("int"))
    return out.withField("cosigner_reasoning", F.when(said.isNotNull(), text_or_empty(reasoning)).otherwise(analysis["cosigner_reasoning"]))


def signer_outcome(said: Column, names: Column) -> Column:
    """found, none, or error (no answer, or quotes that don't stand in the text)."""
    return F.when(said.isNull(), "error").when(~said, "none").when(names.isNull(), "error").otherwise("found")


# --- signer blocks --------------------------------------------------------------------------------------------------

#: fixed patterns: lines of a signature block that name no signer, and a count that a letter states itself
JUNK_LINE = r"(?i)^(page\s*)?\d+(\s*of\s*\d+)?$"
FOOTNOTE_LINE = r"^\d{1,3}\s+\S"
VALEDICTION = r"(?i)^(sincerely|very truly yours|yours truly|respectfully( submitted)?|regards|best regards|cordially)[,.]?$"
CASE_CITATION = r"\sv\.\s.+\(\d{4}\)$"
STATED_COUNT = r"(?i)(\d[\d,]*)\+?\s+(?:multi-sector\s+|other\s+|additional\s+)?(?:organizations?|signator(?:y|ies)|individuals?|co-?signers?|cosigners?|senators?|members?|entities)"


def clean_lines(block: Column) -> Column:
    lines = F.transform(F.split(block, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    junk = lambda x: x.rlike(JUNK_LINE) | x.rlike(FOOTNOTE_LINE) | x.rlike(VALEDICTION) | x.rlike(CASE_CITATION)
    return F.filter(lines, lambda x: (x != "") & ~junk(x))


def single_lines(lines: Column) -> Column:
    """The lines that come once, whatever their case, in their order: equal ones stand side by side once sorted.

    Each sorted line is zipped with its neighbours, so that no line looks at the whole list.
    """
    placed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("line"))))
    low, none = F.transform(placed, lambda p: p["low"]), F.array(F.lit(None).cast("string"))
    rest = F.greatest(F.size(lines) - 1, F.lit(0))
    beside = F.arrays_zip(placed, F.concat(none, F.slice(low, F.lit(1), rest)), F.concat(F.slice(low, F.lit(2), rest), none))
    once = F.filter(beside, lambda z: z["0"].isNotNull() & ~z["0"]["low"].eqNullSafe(z["1"]) & ~z["0"]["low"].eqNullSafe(z["2"]))
    return F.transform(F.array_sort(F.transform(once, lambda z: F.struct(z["0"]["i"].alias("i"), z["0"]["line"].alias("line")))), lambda p: p["line"])


def signers(rows: DataFrame, block: str) -> DataFrame:
    """Adds names and count: lines that come once, or the first line of each part between blank lines.

    The second reading holds for small blocks: at most 15 single lines, and two or more parts that are no more than those.
    """
    rows = rows.withColumn("_b", text_or_empty(block)).withColumn("_l", clean_lines(F.col("_b")))
    rows = rows.withColumn("_dense", single_lines(F.col("_l")))
    parts = F.filter(F.transform(F.split("_b", r"\n\s*\n"), lambda p: F.get(clean_lines(p), F.lit(0))), lambda x: x.isNotNull())
    rows = rows.withColumn("_parts", parts)
    use = (F.size("_dense") <= 15) & (F.size("_parts") >= 2) & (F.size("_parts") <= F.size("_dense"))
    rows = rows.withColumn("names", F.when(use, F.col("_parts")).otherwise(F.col("_dense")))
    stated = F.regexp_replace(F.regexp_extract("_b", STATED_COUNT, 1), ",", "").try_cast("int")
    return rows.withColumn("count", F.coalesce(stated, F.size("names"))).drop("_b", "_l", "_dense", "_parts")


_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_LINE = f"[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+"


def quote_place(text: Column, quote: Column, last: bool = False) -> Column:
    """Struct of how many characters stand before a quote and how many it takes; null where it is absent.

    The quote as it is, else its words with any white space between them; of several places the first or the last one.
    """
    span = lambda before, n: F.struct(before.cast("int").alias("before"), n.cast("int").alias("n"))
    at = F.position(F.reverse(quote), F.reverse(text)) if last else F.position(quote, text)
    before = F.length(text) - (at - 1) - F.length(quote) if last else at - 1
    literal = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    terms = F.array_join(F.transform(F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != ""), literal), r"(?U:\s+)")
    end = -1 if last else 1
    hit, rest = F.try_element_at(F.regexp_extract_all(text, terms, F.lit(0)), F.lit(end)), F.element_at(F.split(text, terms), end)
    loose = F.when((terms != "") & hit.isNotNull(), span(F.length(text) - F.length(rest) - F.length(hit) if last else F.length(rest), F.length(hit)))
    return F.when(at > 0, span(before, F.length(quote))).otherwise(loose)


def _line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.lower(strip(F.regexp_replace(x, "[ \t]+", " "))))


def slice_blocks(rows: DataFrame, text: str, first: str, last: str, ahead: int = 500, rounds: int = 5) -> DataFrame:
    """Adds block: from the last place of one quote to the end of another behind it, empty where one is absent or not given.

    A block goes on to a line that it has already, if that comes again within ``ahead`` characters; so up to ``rounds`` times.
    """
    t, a, b = text_or_empty(text), text_or_empty(first), text_or_empty(last)
    rows = rows.withColumn("_a", F.when((a != "") & (b != ""), quote_place(t, a, last=True)["before"]))
    rows = rows.withColumn("_t", F.substring(t, F.col("_a") + 1, F.length(t))).withColumn("_b", quote_place(F.col("_t"), b))
    rows = rows.withColumn("_n", F.col("_b.before") + F.col("_b.n")).drop("_b")
    for _ in range(rounds):
        had = _line_keys(F.regexp_extract_all(F.substring("_t", F.lit(1), F.col("_n")), F.lit(_LINE), F.lit(0)))
        rows = rows.withColumn("_had", had).withColumn("_next", F.regexp_extract_all(F.substring("_t", F.col("_n") + 1, F.lit(ahead)), F.lit(_LINE), F.lit(0)))
        again = F.array_position(F.transform(_line_keys(F.col("_next")), lambda k: (k != "") & F.array_contains("_had", k)), F.lit(True))
        rows = rows.withColumn("_n", F.col("_n") + F.length(F.array_join(F.slice("_next", F.lit(1), again.cast("int")), "")))
    return rows.withColumn("block", F.coalesce(F.substring("_t", F.lit(1), F.col("_n")), F.lit(""))).drop("_a", "_t", "_n", "_had", "_next")
