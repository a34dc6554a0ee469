"""Evaluation sets: drawing, labelling, scoring, and the data of an accuracy page."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import position
from gristmill.functions.text import any_match, collapse, combined_text, strip, text_or_empty
from gristmill.operators.evaluate import allocate, class_metrics, confusion, prevalence, review_first, reviewed, stratified
from gristmill.storage import materialize

#: fixed values: an answer that for the classifier is the same as no position, and names as shown
FOLD = {"unclear_junk": "no_position"}
PRETTY = {"oppose": "Oppose", "support": "Support", "no_position": "No position / unclear"}
NONE, NO_POSITION = "(none)", "no_position"
#: fixed values: texts this short can't be judged, how much of one a page shows, and half the median where there is none
LEAST_CHARS, SHOWN_CHARS, SHORT_DEFAULT = 40, 1500, 180
EVIDENCE = ("evidence", "case_for", "runner_up", "case_against", "what_makes_it_hard", "reviewer_should_check")


def folded(label: Column) -> Column:
    out = strip(label)
    for name, as_ in FOLD.items():
        out = F.when(out == name, as_).otherwise(out)
    return out


def short_name(label: Column) -> Column:
    """``Position: Oppose the rule`` is oppose, ``(none)`` is no_position."""
    first = F.get(F.split(strip(F.regexp_replace(label, "^[^:]*:", "")), r"\s+"), F.lit(0))
    return F.when(label == NONE, NO_POSITION).otherwise(F.lower(first))


def judged_text(body: Column, attachment: Column) -> Column:
    """What the classifier read, on one line."""
    return collapse(combined_text(strip(body), strip(attachment)))


def audit_text(body: Column, attachment: Column, least: int = 60, chars: int = SHOWN_CHARS) -> Column:
    """A body on one line, with its attachment where it is too short to judge; null where the whole still is."""
    b = strip(body)
    whole = strip(F.when(F.length(b) < least, F.concat(b, F.lit(" || ATTACHMENT: "), text_or_empty(attachment))).otherwise(b))
    return F.when(F.length(whole) > LEAST_CHARS, F.substring(collapse(whole), 1, chars))


def short_cutoff(rows: DataFrame, text: str = "text") -> DataFrame:
    """short_cutoff: half the median length, or the default where that is none."""
    half = F.floor(F.percentile(F.length(F.col(text)), 0.5) / 2).cast("long")
    return rows.agg(F.coalesce(F.nullif(half, F.lit(0).cast("long")), F.lit(SHORT_DEFAULT).cast("long")).alias("short_cutoff"))


def unreadable(rows: DataFrame, body: str = "text", attachment: str = "attachment_text") -> DataFrame:
    """unreadable: how many short bodies point at an attachment that nothing was read from."""
    points = any_match(text_or_empty(body), ["attach", "enclosed"]) & (F.length(text_or_empty(body)) < 400)
    return rows.agg(F.count_if(points & strip(attachment).isin("", "None", "nan")).alias("unreadable"))


def judged(comments: DataFrame, positions: list[str]) -> DataFrame:
    """The comments that can be judged, with what the classifier read as text, pipeline_label and short_cutoff.  Stored."""
    rows = comments.withColumn("text", judged_text(F.col("text"), F.col("attachment_text"))).withColumn("pipeline_label", position.configured(F.col("analysis"), positions))
    rows = materialize(rows, "judged").where(F.length("text") > LEAST_CHARS)
    return rows.crossJoin(F.broadcast(short_cutoff(rows)))


def candidates(comments: DataFrame, positions: list[str], size: int = 200, floor: int = 20, scheme: str = "balanced", seed: str = "eval", url: str = "") -> DataFrame:
    """The rows of an evaluation set: drawn by hash within each position, with the weight of each.

    ``comments``: row_idx, id, text, attachment_text, organization, analysis, campaign_id.  Columns: row_idx, id, pipeline_label,
    label and note (empty, for people), weight, url, is_short, is_org, in_campaign, organization, text.
    """
    rows = judged(comments, positions)
    counts = {r["pipeline_label"]: r["n"] for r in rows.groupBy("pipeline_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a position
    plan = {k: n for k, n in allocate({k: counts[k] for k in [*positions, NONE] if k in counts}, size, scheme, floor).items() if n}
    drawn = stratified(rows, "pipeline_label", plan, "id", seed)
    return drawn.select(
        "row_idx", "id", "pipeline_label", F.lit("").alias("label"), F.lit("").alias("note"), "weight", F.concat(F.lit(url), "id").alias("url"), (F.length("text") < F.col("short_cutoff")).alias("is_short"),
        (strip("organization") != "").alias("is_org"), F.col("campaign_id").isNotNull().alias("in_campaign"), "organization", "text",
    )


def review_sheet(drawn: DataFrame, drafts: DataFrame) -> DataFrame:
    """Candidates with a model's drafts, those worth a person's attention first.

    ``drafts``: id, draft_label and the fields of EVIDENCE; candidates without one have empty fields.
    """
    told = drawn.drop("label").join(drafts.dropDuplicates(["id"]), "id", "left")
    told = told.withColumns({f: text_or_empty(f) for f in ("draft_label", *EVIDENCE)}).withColumn("pipeline_norm", short_name(F.col("pipeline_label")))
    told = told.withColumn("agrees", F.col("pipeline_norm") == F.col("draft_label")).withColumn("label", F.col("draft_label"))
    told = told.withColumn("review_first", review_first(F.col("agrees"), F.col("what_makes_it_hard"), F.col("reviewer_should_check")))
    return told.orderBy(F.desc("review_first"), "agrees", "pipeline_norm", "id")


def labelled(sheet: DataFrame) -> DataFrame:
    """The labelled rows of a sheet with truth, pred, weight (1 where it is no number) and seen (a person has checked the row)."""
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in sheet.columns else F.lit(1.0)
    seen = reviewed(F.col("reviewed")) if "reviewed" in sheet.columns else F.lit(False)
    rows = sheet.where(strip("label") != "")
    return rows.withColumns({"truth": folded(F.col("label")), "pred": folded(F.col("pipeline_norm")), "weight": weight, "seen": seen})


def gold_accuracy(rows: DataFrame, gold: DataFrame, right: Column, *by: str, key: str = "doc_id") -> DataFrame:
    """n, accuracy (by group) of rows that a gold label is known for; of labels of one key the first by their values counts."""
    one = gold.groupBy(key).agg(F.min(F.struct(*[c for c in gold.columns if c != key])).alias("_g")).select(key, "_g.*")
    return rows.join(one, key).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def agreement(rows: DataFrame) -> DataFrame:
    """n, seen, agreement of labelled rows."""
    seen = F.count_if(F.col("seen")) if "seen" in rows.columns else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), seen.alias("seen"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("agreement"))


def score(rows: DataFrame, population: DataFrame) -> dict[str, DataFrame]:
    """Every table of an accuracy page: agreement, weighted and unweighted metrics, prevalence, confusion, rows."""
    shown = [F.substring(strip(c), 1, SHOWN_CHARS).alias(c) if c == "text" else text_or_empty(F.col(c).cast("string")).alias(c) for c in ("id", "url", "organization", *EVIDENCE, "text") if c in rows.columns]
    return {
        "agreement": agreement(rows),
        "weighted": class_metrics(rows, weight=F.col("weight")),
        "unweighted": class_metrics(rows),
        "prevalence": prevalence(rows, population),
        "confusion": confusion(rows),
        "rows": rows.orderBy("pred", "truth", "id").select(*shown, "truth", "pred", (F.col("truth") == F.col("pred")).alias("match"), "seen", "weight"),
    }


def score_document(tables: dict[str, DataFrame], unreadable_rows: int = 0, **about: Any) -> dict[str, Any]:
    """The tables as one document for a page; an evaluation set is some hundreds of rows."""
    rounded = lambda r: {k: round(v, 4) if isinstance(v, float) else v for k, v in r.asDict().items()}
    return {**about, "pretty": PRETTY, "unreadable": unreadable_rows, **{k: [rounded(r) for r in t.collect()] for k, t in tables.items()}}


def accuracy_rows(rows: DataFrame, mode: str = "all", cell: tuple[str, str] | None = None, contains: str = "") -> DataFrame:
    """Score rows by agreement (all, agree, mismatch), by one cell (truth, pred) of the confusion table, and by a text in any field."""
    keep = {"all": F.lit(True), "agree": F.col("truth") == F.col("pred"), "mismatch": F.col("truth") != F.col("pred")}[mode]
    if cell:
        keep = keep & (F.col("truth") == cell[0]) & (F.col("pred") == cell[1])
    if contains:
        keep = keep & F.lower(F.concat_ws("\n", *[F.col(n).cast("string") for n, t in rows.dtypes if t == "string"])).contains(contains.lower())
    return rows.where(keep)


def stages(described: Iterable[dict[str, Any]], history: dict[str, list[dict]] | None = None, n_labelled: int = 0, n_seen: int = 0) -> list[dict[str, Any]]:
    """A pipeline's stages as a page tells them: name, model, what it does, its prompt and earlier prompts, and how far review went."""
    out = [{"name": s["name"], "model": s.get("model", ""), "about": s.get("about", ""), "prompt": s.get("prompt", ""), "history": (history or {}).get(s["name"], [])} for s in described]
    review = f"{n_seen} of {n_labelled} labels were checked by a person." if n_seen else "No label was checked by a person yet."
    return [*out, {"name": "review", "model": "", "about": review, "prompt": "", "history": []}]
