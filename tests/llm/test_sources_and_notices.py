"""Fill-in-middle, divergence of sources and license scans, against plain programs and their SQL, with hard rows."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import bytewords, divergence, fim, licenses, sql
from gristmill.llm.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n int, rank int, words string, block string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, 2, "w", "b") for r in rows], DOCS)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- words ----------------------------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ09 _[`{@é中\x00\n"), st.characters(codec="utf-8")), max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for kept, pattern in ((bytewords.table(bytewords.LETTERS), "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), (licenses.KEPT, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        found, sizes = bytewords.cut(pa.array(["x", *texts], pa.string())[1:], kept)
        want = [re.findall(pattern, t.translate(LOW)) for t in texts]
        assert found.to_pylist() == [w for ws in want for w in ws]
        assert sizes.tolist() == [len(ws) for ws in want]


def test_slices_cover_all_rows_and_a_long_text_is_alone():
    texts = pa.array(["aa", "b" * 50, "", "cc", "dd"], pa.string())
    assert list(bytewords.slices(texts, 5)) == [(0, 1), (1, 2), (2, 5)]
    assert list(bytewords.slices(texts[1:3], 5)) == [(0, 1), (1, 2)]
    assert list(bytewords.slices(texts[:0], 5)) == []


# --- fill-in-middle -------------------------------------------------------------------------------------------------


@given(st.text(alphabet=st.one_of(st.sampled_from("abZ [`{@\n1é中"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_runs_find_the_place_of_every_token(text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    runs, at = fim.Runs(text), 0
    assert runs.n == len(tokens)
    for k, t in enumerate(tokens):
        assert runs.place(k) == at
        at += len(t)
    assert runs.place(runs.n) == len(text)


def plain_fim(doc_id, text, seed=1):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text or ""
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(tokens), form, len(p), len(m), out


def fim_rows():
    rng = random.Random(11)
    texts = [None, "", "a", "<", "a <P> b", "x<S>", "a<b>c<P", ">", "ab\n\n  cd é中 𝄞x", "w" * 4000, "1234567890" * 300, "word, " * 5000]
    texts += ["".join(rng.choice("ab<>PSM \n.é𝄞") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    rows = [(i, t, None, "s") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, "no id here", "en", None), (-5, "below zero", "en", None)]


def test_texts_are_cut_and_come_back(spark):
    out = fim.transformed(docs(spark, fim_rows())).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    want = sorted(((d, *plain_fim(d, t), t or "") for d, t, _, _ in fim_rows()), key=repr)
    assert collected(out) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_other_marks_seeds_and_shares(spark):
    rows = docs(spark, [(i, f"text number {i} (.*)", None, None) for i in range(40)])
    marks = ("[pre]", "$", "\\E!")
    out = fim.transformed(rows, seed=2, marks=marks, share=100, suffix_first=50).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in out} == {"psm", "spm"}
    assert all(r["back"] == f"text number {r['doc_id']} (.*)" for r in out)


def test_no_documents_no_rows(spark):
    none = docs(spark, [])
    assert fim.transformed(none).count() == 0
    assert divergence.audit(none).count() == 0
    assert licenses.scan(none).count() == 0


# --- divergence -----------------------------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    seen, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        groups[lang].add(source)
        seen[lang].update(set(terms))
        n[lang, source].update(terms)
    share = lambda c, words: 1 + 10**9 * (c + 1) // words
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in seen[lang].items() if c >= least]
        total = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        words = {s: sum(n[lang, s][t] for t in kept) + len(kept) for s in sources}
        p = {s: {t: share(n[lang, s][t], words[s]) for t in kept} for s in sources}
        q = {t: share(total[t], sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            found = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(found))]
            found = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def audit_rows():
    rng = random.Random(12)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "中", "ﬁ", "Zz"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["s0"] * 5 + [f"s{k}" for k in range(9)] + [None, "", "é", "𝄞", "ﬀ"])) for i in range(260)]
    rows += [(900, None, "en", "none"), (901, "", "en", "none"), (902, "1 2 3", "xx", "digits"), (903, "only once here", "yy", "s0"), (None, "wa wa", "en", "s1")]
    return [*rows, rows[3], rows[3], (904, "aa bb " * 20_000, "en", "long")]


@pytest.mark.parametrize(("chunk", "block", "run"), [(7, 3, 2), (1 << 14, 16, 8), (1, 1, 100)])
def test_audit_agrees_with_a_plain_program(spark, chunk, block, run):
    got = divergence.audit(docs(spark, audit_rows()), top=25, chunk=chunk, block=block, run=run)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collected(got) == plain_audit(audit_rows(), top=25)


def test_many_groups_are_joined_and_not_sent(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    assert collected(divergence.audit(docs(spark, audit_rows()), top=25, chunk=20, block=4)) == plain_audit(audit_rows(), top=25)


def test_shares_are_exact_beyond_64_bits(spark):
    n = [0, 1, 10**9, 9 * 10**9 - 2, 9 * 10**9, 10**13, 123456789012345]
    words = 10**15 + 7
    want = [1 + 10**9 * (x + 1) // words for x in n]
    assert divergence.shares(np.array(n, np.int64), words).tolist() == want
    rows = spark.createDataFrame([(x, words) for x in n], "n long, words long").select("n", divergence.share(F.col("n"), F.col("words")).alias("p"))
    assert dict(collected(rows)) == dict(zip(n, want, strict=True))


# --- licenses -------------------------------------------------------------------------------------------------------


def plain_scan(text, templates=licenses.TEMPLATES, threshold=0.9):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    ws = words(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    best, found = 0.0, set()
    for label, t in templates:
        size, wide = len(set(words(t))), licenses.stride(len(words(t)))
        for k in range(0, len(ws), wide):
            common = len(set(words(t)) & set(ws[k : k + 2 * wide]))
            if size and common >= math.ceil(size * threshold - 1e-9):
                found.add(label)
                best = max(best, common / size)
    starts = [i for i, _ in at]
    base = {label for _, label in at}
    return len(ws), len(at), min(starts, default=None), max(starts, default=None), sorted(base), sorted(found), 1.0 if at else best


def notice_rows():
    rng = random.Random(13)
    filler = [f"f{i}" for i in range(300)] + ["the", "license", "software", "of", "and", "any"] * 10
    prose = lambda n: [rng.choice(filler) for _ in range(n)]
    texts = [None, "", " \n ", "MIT License", "mit license apache LICENSE general public license", "mit", "license mit", "general public", "é license"]
    for _, t in licenses.TEMPLATES:
        ws = t.split()
        texts += [t, " ".join([*prose(rng.randint(0, 300)), *ws, *prose(rng.randint(0, 300))])]
        for drop in (1, 2, max(1, len(ws) // 8)):
            less = [w for i, w in enumerate(ws) if i not in set(rng.sample(range(len(ws)), min(drop, len(ws))))]
            more = [x for w in less for x in ([w, rng.choice(filler)] if rng.random() < 0.1 else [w])]
            texts.append(" ".join([*prose(rng.randint(0, 60)), *more, *prose(40)]))
        texts.append(" ".join(rng.sample(ws, len(ws))))
    texts.append(" ".join([*prose(30_000), "Released under the MIT License.", *prose(30_000), *licenses.TEMPLATES[4][1].split()]))
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, "Licensed under CC BY-NC 4.0", None, None), (9, "another text of one id: mit license", None, None)]


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_scan_agrees_with_all_blocks_against_all_templates(spark, threshold):
    got = collected(licenses.scan(docs(spark, notice_rows()), threshold=threshold))
    assert got == sorted(((d, *plain_scan(t, threshold=threshold)) for d, t, _, _ in notice_rows()), key=repr)
    assert sum(bool(r[6]) and not r[5] for r in got) > 20  # found by templates alone


def test_prefixes_can_be_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(licenses, "FEW_PREFIXES", 0)
    rows = [r for r in notice_rows() if r[0] is None or r[0] < 60]
    assert collected(licenses.scan(docs(spark, rows))) == sorted(((d, *plain_scan(t)) for d, t, _, _ in rows), key=repr)


def test_templates_of_any_shape(spark):
    templates = [("none", "?!"), ("one", "solo"), ("twice", "solo solo solo"), ("two", "solo duo")]
    rows = [(1, "solo", None, None), (2, "duo solo", None, None), (3, "trio", None, None), (4, "duo " * 20 + "x " * 40 + "solo", None, None)]
    assert {r["doc_id"]: sorted(r["found"]) for r in licenses.scan(docs(spark, rows), templates).collect()} == {1: ["one", "twice"], 2: ["one", "twice", "two"], 3: [], 4: ["one", "twice"]}


def test_too_many_template_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_TOKENS", 10)
    with pytest.raises(ValueError, match="10 at most"):
        licenses.scan(docs(spark, []))


# --- the queries ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_source_divergence", "op13_license_join"])
def test_query_agrees_with_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, sf)
    found = con.execute(sql.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert set(got.columns) == set(at)
    assert collected(got) == sorted((tuple(r[at[n]] for n in got.columns) for r in found.fetchall()), key=repr)
