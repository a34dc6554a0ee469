import pytest
from pyspark.sql import functions as F

from gristmill.functions import numbers, position
from gristmill.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [("  Ab\n", "ab"), ("\tÉ x ", "é x"), (None, ""), ("", "")])
def test_text_key(spark, raw, want):
    assert one(spark, T.text_key(F.lit(raw).cast("string"))) == want


def test_campaign_form_glues_lines(spark):
    assert one(spark, T.campaign_form(F.lit("Stop,  the\nrule! "))) == "stop therule"


def test_shingles(spark):
    w = F.split(F.lit("a b c d e f"), " ")
    assert one(spark, T.shingles(w)) == ["a b c d e", "b c d e f"]
    few = F.split(F.lit("a b"), " ")
    assert one(spark, T.shingles(few)) == []
    assert one(spark, T.shingles(few, short_ok=True)) == ["a b"]


def test_sentences(spark):
    t = F.lit("First one. Second has DEI here! Third.")
    assert one(spark, T.matching_sentence(t, [r"\bdei\b"])) == "Second has DEI here!"
    assert one(spark, T.matching_sentence(t, ["("])) == ""
    assert one(spark, T.matching_sentence(t, [])) == ""


def test_snippet_and_preview(spark):
    assert one(spark, T.snippet(F.lit("a  b " * 30), 7)) == "a b a b…"
    assert one(spark, T.preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert one(spark, T.preview(F.lit("x" * 200))) == "x" * 200


@pytest.mark.parametrize("raw, want", [("", True), ("ab", True), ("\x01" * 200, True), ("Jane Doe, CA\nJohn Roe, TX\n" * 5, False), ("1234567890 12345", True), ("An English sentence stands here.", False), ("Una frase en español con eñes.", False)])
def test_gibberish(spark, raw, want):
    assert one(spark, T.gibberish(F.lit(raw))) is want


@pytest.mark.parametrize("raw, want", [("2026-07-13T04:00Z", "2026-07-13"), ("2026-07-13T04:00:00Z", "2026-07-13"), ("soon enough, I say", "soon enoug"), (None, "")])
def test_iso_date(spark, raw, want):
    assert one(spark, T.iso_date(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("n, total, want", [(42, 167864, 0.03), (1, 3, 33.3), (0, 5, 0.0), (3, 0, 0.0), (1, 10_000_000, 0.00001)])
def test_display_pct(spark, n, total, want):
    assert one(spark, numbers.display_pct(F.lit(n), F.lit(total))) == pytest.approx(want)


def test_split_pct(spark):
    assert one(spark, numbers.split_pct(F.lit(1), F.lit(7))) == 12  # 12.5 goes to the even neighbour
    assert one(spark, numbers.split_pct(F.lit(0), F.lit(0))) == 100


def test_labels():
    assert T.flag_label("mentions_rule_of_law") == "Rule of Law"
    assert T.flag_label("x", "Own label") == "Own label"
    assert T.slug("a b (c)") == "a_b_c"
    assert T.rgb("#0a0b0c") == "10, 11, 12" and T.rgb("nope") == "0, 0, 0"


CASES = [
    # stances, verified -> shown, card, conflict, gate, population
    (None, None, "Unclear", "Unclear", "", "none", "no_position"),
    ([], None, "Unclear", "Unclear", "other", "none", "no_position"),
    (["Position: Oppose"], None, "Oppose", "Oppose", "Oppose", "Oppose", "oppose"),
    (["Position: Support", "Position: Oppose"], None, "Support", "Support", "Oppose", "Oppose", "support"),
    (["Concern: x"], None, "Unclear", "Unclear", "other", "other", "no_position"),
    (["Position: Oppose"], "Support", "Support", "Oppose", "Oppose", "Oppose", "oppose"),
    (["Position: Oppose"], "Unclear", "Unclear", "Unclear", "Oppose", "Oppose", "oppose"),
]


@pytest.mark.parametrize("case", CASES)
def test_positions(spark, case):
    df = spark.createDataFrame([((case[0], case[1]),)], "a struct<stances:array<string>,verified_stance:string>")
    a = F.col("a")
    got = df.select(position.shown(a), position.card(a), position.conflict(a), position.gate(a), position.population(a)).first()
    assert tuple(got) == case[2:]


def test_label_text(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    assert one(spark, T.label_text(F.lit("See attached file(s)"), F.lit("letter"))) == "letter"
    assert one(spark, T.label_text(F.lit(long), F.lit("letter"))) == long
    assert one(spark, T.label_text(F.lit("short"), F.lit(""))) == "short"
