"""What a report shows: counts with position splits, samples, campaign statistics, filters, rows and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.numbers import display_pct, split_pct
from gristmill.functions.text import preview, snippet, strip
from gristmill.storage import materialize


def share_by(rows: DataFrame, bucket: str) -> DataFrame:
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(bucket, "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))


def headline(rows: DataFrame, position: str = "position") -> DataFrame:
    """One row: comments, each position's count and display percent, attachments."""
    attached = F.count_if(strip("attachment_text") != "") if "attachment_text" in rows.columns else F.lit(0).cast("long")
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(position) == p).alias(p.lower()) for p in ("Oppose", "Support", "Unclear")], attached.alias("with_attachments"))
    return counts.select("*", *[display_pct(F.col(p), F.col("total")).alias(f"{p}_pct") for p in ("oppose", "support", "unclear")])


def split_counts(rows: DataFrame, tag: str, position: str = "position") -> DataFrame:
    """tag, n, oppose, support, unclear, oppose_pct, support_pct, first row."""
    out = rows.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(position) == p).alias(p.lower()) for p in ("Oppose", "Support", "Unclear")], F.min("row_idx").alias("first_idx"))
    pct = split_pct(F.col("oppose"), F.col("support"))
    return out.withColumn("oppose_pct", pct).withColumn("support_pct", F.when(F.col("oppose") + F.col("support") > 0, 100 - pct).otherwise(0))


def concern_tags(rows: DataFrame, analysis: str = "analysis") -> DataFrame:
    """A row for each concern tag (a tag that comes twice counts twice)."""
    tags = F.filter(F.coalesce(F.col(analysis)["stances"], F.array().cast("array<string>")), lambda s: s.startswith("Concern:"))
    return rows.withColumn("tag", F.explode(tags)).withColumn("concern", F.regexp_replace("tag", "^Concern: ?", "")).drop("tag")


def samples(rows: DataFrame, group: str, n: int, value: str = "id", order: str = "row_idx") -> DataFrame:
    """group, n, the first ``n`` values in input order.  The rank limit runs before the shuffle."""
    few = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= n)
    few = few.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias("samples"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(few, group)


def plurality(oppose: Column, support: Column, unclear: Column) -> Column:
    """The position with strictly most comments; ties and unclear are Mixed."""
    return F.when((oppose > support) & (oppose > unclear), "Oppose").when((support > oppose) & (support > unclear), "Support").otherwise("Mixed")


def campaign_stats(rows: DataFrame, campaign: str = "campaign", position: str = "position", canonical: DataFrame | None = None, n_samples: int = 10) -> DataFrame:
    """A row a campaign: split_counts, stance, rank, and with ``canonical`` (campaign, canonical) also how many comments are that
    text exactly, its preview and snippet, and the first ids.
    """
    members = rows.where(F.col(campaign).isNotNull())
    out = split_counts(members, campaign, position).withColumn("stance", plurality(F.col("oppose"), F.col("support"), F.col("unclear")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first_idx")))
    if canonical is None:
        return out
    texts = canonical.select(campaign, F.col("canonical"), F.sha2("canonical", 256).alias("_p"))
    asked = texts.select("_p").distinct()
    copies = rows.select(F.sha2(strip("text"), 256).alias("_p")).where(strip("text") != "").groupBy("_p").agg(F.count(F.lit(1)).alias("exact")).join(asked, "_p")
    told = texts.join(copies, "_p", "left").select(campaign, F.coalesce("exact", F.lit(0)).alias("exact"), preview("canonical").alias("preview"), snippet("canonical").alias("snippet"))
    return out.join(told, campaign, "left").join(samples(members, campaign, n_samples).select(campaign, "samples"), campaign, "left")


def _section(name: str, rows: DataFrame, by: str, total: DataFrame, n_samples: int) -> DataFrame:
    """section, place, name, n, oppose, support, unclear, oppose_pct, support_pct, pct, samples: groups in order of size, then of their first row."""
    counts = split_counts(rows, by).join(samples(rows, by, n_samples).select(by, "samples"), by).crossJoin(F.broadcast(total))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "first_idx"))  # a row a group
    return counts.select(F.lit(name).alias("section"), place.alias("place"), F.col(by).cast("string").alias("name"), "n", "oppose", "support", "unclear", "oppose_pct", "support_pct", display_pct(F.col("n"), F.col("total")).alias("pct"), "samples")


def whole_briefing(rows: DataFrame, n_samples: int = 200, campaign_samples: int = 10) -> DataFrame:
    """All that a report opens with, as one table: a row for each total, concern, entity type, state, party and campaign.

    ``rows``: row_idx, id, analysis, position, attachment_text, campaign_id.  Groups come in order of size, those of a size as
    they are first seen, with the first ids of each; pct is of all comments.  Concerns count as often as they are tagged.
    """
    a = F.col("analysis")
    rows = materialize(rows.select("row_idx", "id", "position", "campaign_id", (strip("attachment_text") != "").alias("attached"), a["stances"].alias("stances"), F.coalesce(a["entity_type"], F.lit("Individual/Other")).alias("entity"), strip(a["state_identified"]).alias("state"), strip(a["political_affiliation"]).alias("party")), "briefing-rows")
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    split = [F.count_if(F.col("position") == p).alias(p.lower()) for p in ("Oppose", "Support", "Unclear")]
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), *split, F.min("row_idx").alias("f")).withColumn("name", F.lit("comments"))
    attached = rows.where("attached").agg(F.count(F.lit(1)).alias("n"), *split, F.min("row_idx").alias("f")).withColumn("name", F.lit("with attachments"))
    in_campaigns = rows.where("campaign_id is not null").agg(F.count(F.lit(1)).alias("n"), *split, F.min("row_idx").alias("f")).withColumn("name", F.lit("in campaigns"))
    pct = split_pct(F.col("oppose"), F.col("support"))
    out = None
    for place, t in enumerate((all_, attached, in_campaigns), 1):
        t = t.crossJoin(F.broadcast(total)).select(F.lit("totals").alias("section"), F.lit(place).alias("place"), "name", "n", "oppose", "support", "unclear", pct.alias("oppose_pct"), F.when(F.col("oppose") + F.col("support") > 0, 100 - pct).otherwise(0).alias("support_pct"), display_pct(F.col("n"), F.col("total")).alias("pct"), F.array().cast("array<string>").alias("samples"))
        out = t if out is None else out.unionByName(t)
    parts = [("concerns", concern_tags(rows.withColumn("analysis", F.struct("stances"))), "concern", n_samples), ("entity types", rows, "entity", n_samples), ("states", rows.where("state <> ''"), "state", n_samples), ("parties", rows.where("party <> ''"), "party", n_samples), ("campaigns", rows.where("campaign_id is not null"), "campaign_id", campaign_samples)]
    for name, part, by, many in parts:
        out = out.unionByName(_section(name, part, by, total, many))
    return out


def group_samples(rows: DataFrame, group: str, fields: list[str], n: int = 200) -> DataFrame:
    """group, n, first row, and of its first ``n`` rows the fields, as an array of records; blank groups are left out."""
    kept = rows.where(strip(group) != "").withColumn("_v", F.struct(*fields))
    counts = kept.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_idx"))
    return counts.join(samples(kept, group, n, "_v").select(group, "samples"), group)


def date_range(rows: DataFrame, day: str) -> DataFrame:
    d = F.try_to_timestamp(F.nullif(strip(day), F.lit("")))
    return rows.agg(F.date_format(F.min(d), "yyyy-MM-dd").alias("first"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last"))


def mode(rows: DataFrame, column: str, missing: str = "unknown", order: str = "row_idx") -> DataFrame:
    """The most common value that isn't blank; of equals the one seen first."""
    counts = rows.where(strip(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    best = counts.agg(F.max_by(column, F.struct("n", -F.col("f"))).alias("value"))
    return best.select(F.coalesce("value", F.lit(missing)).alias("value"))


def shards(rows: DataFrame, fields: list[str], size: int = 500, order: str = "row_idx") -> DataFrame:
    """shard, n, body (JSON object by id) of consecutive rows.

    Positions come from counts per range of the order key, so that no single task numbers all rows.
    """
    numbered = with_position(rows, order)
    body = F.to_json(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct("id", F.struct(*fields).alias("v")).alias("e")))), lambda x: x["e"])))
    return numbered.withColumn("shard", F.floor(F.col("position") / size).cast("int")).groupBy("shard").agg(F.count(F.lit(1)).cast("int").alias("n"), body.alias("body"))


def with_position(rows: DataFrame, order: str, block: int = 65536) -> DataFrame:
    """Adds the position of each row in ascending ``order`` (an integer), counted in blocks of the key."""
    keyed = rows.withColumn("_b", F.floor(F.col(order) / block))
    per = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = per.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return keyed.withColumn("_i", inside).join(ahead, F.col("_b") == F.col("_k")).withColumn("position", F.col("_ahead") + F.col("_i")).drop("_b", "_k", "_i", "_ahead")
