"""Quality rules whose cutoffs are chosen so that good documents are rejected no more often than promised.

A base rule rejects short and self-repeating texts.  Five more rules each bound a ratio, with cutoffs from loose to strict.
What is chosen for a stratum (language) is a setting: which rules are in use, and one step for all of them.  The labelled
good documents of the stratum that pass the base rule are the holdout: under a setting, k of n of them would be rejected by
any of its rules.  The exact binomial test of "the setting rejects more than ``risk`` of the good documents" has the p-value
P(Binomial(n, risk) <= k).  For every set of rules the steps are tested in their order, from loose to strict, until one
fails, which needs no correction along a sequence; over strata and sets of rules the level ``delta`` is divided by the
number of sequences (Bonferroni).  So with probability 1 - delta no setting that passes, in any stratum, rejects more than
``risk`` of the stratum's good documents, whichever of them is taken.

Taken is the one that rejects most of the stratum's labelled bad documents; of equals the one that rejects fewest good
ones, then the loosest, then the one with the fewest rules in the order below.  Without one that passes, and without
labels, only the base rule is in use.

Rows: null text counts as empty; it and texts without a word fail the base rule.  A null language is a stratum of its
own.  Documents labelled more than once are good if all labels say so, else bad.  Repeated rows get equal results.  An empty
table gives an empty result, an empty label table leaves the base rule.  Other columns may have any names.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.storage import materialize

SPACE = r"[\x20\x09-\x0D]+"
RISK = 0.02
DELTA = 0.1
MIN_WORDS = 50
#: rule -> (the ratio in terms of the features, cutoffs from loose to strict); a ratio above its cutoff is rejected
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (1.5, 1.0, 0.75, 0.5, 0.25, 0.1)),
    "bangs": ("n_bangs / n_words", (1.5, 1.0, 0.75, 0.5, 0.25, 0.1)),
    "capitals": ("n_capitals / word_chars", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "same_lines": ("n_dup_lines / n_lines", (0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
}
STEPS = 6
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")
#: Terms of a binomial tail that are added one by one; a geometric bound covers those below.
TAIL_TERMS = 4000


def _count(text: str, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def features(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Adds FEATURES to rows that have the column ``text``, and takes that column away."""
    rows = rows.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = {
        "word_chars": _count(text, SPACE),
        "n_symbols": _count(text, r"[^#*$%&|<>]+"),
        "n_bangs": _count(text, r"[^!]+"),
        "n_capitals": _count(text, r"[^A-Z]+"),
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2]))).otherwise(F.array().cast("array<bigint>")),
    }
    rows = rows.withColumns(counts).drop(text, "_words", "_lines")
    rows = rows.withColumn("_sorted", F.sort_array("_windows"))
    rows = rows.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.col("_sorted")[i - 1])))).drop("_sorted")
    # where windows that occur again start: by looking each up among few, else by sorting windows with their places
    few = F.filter(F.sequence(F.lit(0), F.size("_windows") - 1), lambda i: F.array_contains("_twice", F.col("_windows")[i]))
    rows = rows.withColumn("_placed", F.when(F.size("_twice") > 24, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda i, j: F.get("_placed", i)["x"] == F.get("_placed", j)["x"]
    many = F.sort_array(F.transform(F.filter(F.transform("_placed", lambda p, k: F.struct(p["i"].alias("i"), (F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False))).alias("again"))), lambda p: p["again"]), lambda p: p["i"]))
    rows = rows.withColumn("_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 24, few).otherwise(many)).drop("_windows", "_twice", "_placed")
    covered = F.aggregate(F.transform("_at", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.col("_at")[k - 1]))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _log_gamma(x: Column) -> Column:
    """Stirling's series, ten places further up."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    for j in range(10):
        series = series - F.log(x + float(j))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below n * p, else 1; never below the true value by more than rounding."""
    k, n = k.cast("double"), n.cast("double")
    at_k = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  term i - 1 over term i
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(float(TAIL_TERMS))).cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, lambda a, j: F.struct((a["term"] * ratio(k - j + 1)).alias("term"), (a["sum"] + a["term"] * ratio(k - j + 1)).alias("sum")))
    rest_ratio = ratio(k - TAIL_TERMS)
    rest = F.when(k > TAIL_TERMS, tail["term"] * rest_ratio / (1 - rest_ratio)).otherwise(0.0)
    return F.when(k < n * p, F.least(F.lit(1.0), F.exp(at_k) * (tail["sum"] + rest))).otherwise(1.0)


def _first_step(rule: str) -> Column:
    """The step from which on the rule rejects a document; as many as there are steps if none does."""
    ratio, total = _ratio(rule), F.lit(0)
    for cut in RULES[rule][1]:
        total = total + F.when(ratio <= cut, 1).otherwise(0)
    return total


def settings(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, mask (bit i: the i-th rule is in use), step, n, good, bad (rejected ones), passed, of every setting."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("q")).where("q is not null").groupBy("l_id").agg(F.min("q").alias("q"))
    held = measured.where(~base_failed()).join(known, F.col("_id") == F.col("l_id")).select("_stratum", "q", *[_first_step(r).alias(f"s_{r}") for r in RULES])
    # a row for each combination of steps that occurs, at most (steps + 1) ** rules a stratum
    cells = held.groupBy("_stratum", *[f"s_{r}" for r in RULES]).agg(F.count_if(F.col("q") == 1).alias("g"), F.count_if(F.col("q") != 1).alias("b"))
    cells = cells.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(2 ** len(RULES) - 1))))
    least = F.least(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"s_{r}")).otherwise(STEPS) for i, r in enumerate(RULES)])
    per = cells.groupBy("_stratum", "mask", least.alias("first")).agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    steps = per.groupBy("_stratum", "mask").agg(F.sum("g").alias("n"), F.collect_list(F.struct("first", "g", "b")).alias("c")).where("n > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    upto = lambda name: F.aggregate(F.filter("c", lambda x: x["first"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x[name])
    # some rows a stratum from here on
    steps = materialize(steps.select("_stratum", "mask", "step", "n", upto("g").alias("good"), upto("b").alias("bad")), "rules-settings")
    strata = steps.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("_stratum")), F.lit("")))).first()[0]
    failed = binomial_tail(F.col("good"), F.col("n"), risk) > F.lit(delta) / (2 ** len(RULES) - 1) / F.lit(max(1, strata))
    so_far = Window.partitionBy("_stratum", "mask").orderBy("step")
    return steps.withColumn("passed", F.max(failed.cast("int")).over(so_far) == 0)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and, for each rule, the cutoff in use (null: none).  ``measured`` has _id, _stratum and FEATURES."""
    tested = settings(measured, labels, risk, delta).where("passed")
    best = tested.groupBy(F.col("_stratum").alias("c_stratum")).agg(F.max(F.struct("bad", -F.col("good"), -F.col("step"), -F.col("mask"), "mask", "step")).alias("s"))
    used = lambda i: F.col("s.mask").bitwiseAND(F.lit(1 << i)) != 0
    return best.select("c_stratum", *[F.when(used(i), F.element_at(F.array(*map(F.lit, cs)), F.col("s.step") + 1)).alias(f"cut_{r}") for i, (r, (_, cs)) in enumerate(RULES.items())])


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    out = measured.join(cuts, F.col("_stratum").eqNullSafe(F.col("c_stratum")), "left")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def measure(docs: DataFrame) -> DataFrame:
    """doc: the whole row; _id, _stratum, FEATURES."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.doc_id").cast("long").alias("_id"), F.col("doc.lang").cast("string").alias("_stratum"), F.col("doc.text").cast("string").alias("_text"))
    return features(rows)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    measured = materialize(measure(docs), "rules-measured")
    return judged(measured, cutoffs(measured, labels, **options)).where("kept").select("doc.*")


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    measured = materialize(measure(docs).drop("doc"), "rules-measured")
    out = judged(measured, cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(F.col("_id").alias("doc_id"), *FEATURES[:5], "base_failed", "kept", *FEATURES[5:])
