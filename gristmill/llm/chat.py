"""Chat formatting that is proved by parsing it back.

Grammar: a conversation is its turns one after the other,

    user       [INST] text [/INST]        system    [SYS] text [/SYS]
    assistant  <s> text </s>              any other [ROLE] role [TEXT] text [/ROLE]

without the blanks shown here.  A text (or role) holds none of these control strings: there, a backslash stands after a
control string's first character, and a control string that already has backslashes in that place gets one more.
Reading takes one away.  No control string holds the first character of another, so what is written can be read in
one way only.

Each conversation is first rendered as it is and parsed; where the turns that come back differ from the source, its
texts are escaped, rendered and parsed again.  ``round_trip`` says whether the result is identical, which it always is.

The loss mask has the span of every assistant text, in code points of the formatted text.

Rows: null text and null role count as empty.  Turns are ordered by turn (null first), ties by role, then text;
repeated rows are turns of their own.  All rows with a null conv_id are one conversation.  An empty table gives an empty
result.  Other columns are ignored, whatever their names.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: first character and rest of every control string
_OPEN = r"([\[<])"
_REST = r"(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)"
_TURN = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"(\\*)" + _REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\(\\*)" + _REST, "$1$2$3")


def _render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("[SYS]"), text, F.lit("[/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[TEXT]"), text, F.lit("[/ROLE]")))
    )


def render(turns: Column, escaped: bool) -> Column:
    """``turns``: array<struct<role, text>>."""
    safe = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: _render_turn(F.when(t["role"].isin("user", "assistant", "system"), t["role"]).otherwise(safe(t["role"])), safe(t["text"]))), "")


def _between(part: Column, before: int, after: int) -> Column:
    return F.substring(part, F.lit(before + 1), F.length(part) - (before + after))


def _read_turn(part: Column) -> Column:
    inner = F.substring(part, F.lit(7), F.length(part) - 13)
    role, text = F.substring_index(inner, "[TEXT]", 1), F.substring(inner, F.length(F.substring_index(inner, "[TEXT]", 1)) + 7, F.length(inner))
    turn = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    return (
        F.when(part.startswith("[INST]"), turn(F.lit("user"), unescape(_between(part, 6, 7))))
        .when(part.startswith("[SYS]"), turn(F.lit("system"), unescape(_between(part, 5, 6))))
        .when(part.startswith("<s>"), turn(F.lit("assistant"), unescape(_between(part, 3, 4))))
        .otherwise(turn(unescape(role), unescape(text)))
    )


def pieces(formatted: Column) -> Column:
    """The formatted text cut into its turns."""
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def parse(formatted: Column, parts: Column) -> Column:
    """The turns, or null where the text isn't wholly made of turns."""
    whole = F.array_join(parts, "") == formatted
    return F.when(whole, F.transform(parts, _read_turn))


def _loss_spans(parts: Column) -> Column:
    """start and stop of the text of every assistant turn.

    Where a turn begins is the sum of all before it.  An array that grows is copied each time, so turns are taken in groups
    of about as many as there are groups: first the groups' sums, then the turns in each group.
    """
    size = F.greatest(F.ceil(F.sqrt(F.size(parts))), F.lit(1)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), size), lambda i: F.slice(parts, i + 1, size))
    chars = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, p: a + F.length(p)))
    none = F.array().cast("array<bigint>")
    begins = F.aggregate(chars, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    span = lambda at, p: F.struct((at + 3).alias("start"), (at + F.length(p) - 4).alias("stop"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.when(p.startswith("<s>"), F.concat(a["spans"], F.array(span(a["at"], p)))).otherwise(a["spans"]).alias("spans"))
    within = lambda g, at: F.aggregate(g, F.struct(at.alias("at"), empty.alias("spans")), step, lambda a: a["spans"])
    return F.flatten(F.zip_with(groups, begins, within))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, stop of every assistant text), escaped, round_trip."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    talks = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    talks = talks.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    talks = talks.withColumn("plain", render(F.col("turns"), False)).withColumn("parts", pieces(F.col("plain")))
    talks = talks.withColumn("fine", F.coalesce(parse(F.col("plain"), F.col("parts")) == F.col("turns"), F.lit(False))).drop("parts")
    talks = talks.withColumn("formatted", F.when(F.col("fine"), F.col("plain")).otherwise(render(F.col("turns"), True))).drop("plain")
    talks = talks.withColumn("parts", pieces(F.col("formatted")))
    return talks.select("conv_id", "formatted", _loss_spans(F.col("parts")).alias("loss_spans"), (~F.col("fine")).alias("escaped"), F.coalesce(parse(F.col("formatted"), F.col("parts")) == F.col("turns"), F.lit(False)).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text: what the output itself says."""
    out = formatted.withColumn("parts", pieces(F.col("formatted"))).withColumn("turns", parse(F.col("formatted"), F.col("parts"))).drop("parts")
    text = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return out.withColumn("loss_text", text)


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.sql("select -7L as conv_id, cast(turn as long) as turn, role, '</s>[INST] ok [/INST]' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    out = read_back(format_conversations(rows.unionByName(hard)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
