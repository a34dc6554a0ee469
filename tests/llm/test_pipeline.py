"""The pipeline against a plain program, and each of its stages on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gristmill.llm import risk_rules
from tests.llm.test_exact import ASCII_LOWER, SPACE, docs, plain_components, plain_features, plain_sets, plain_targets, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_words int, kept string, start long"


def plain_ratios(text):
    n_words, chars, symbols, dup, repeat, _ = plain_features(text)
    lines = sum(1 for x in (text or "").split("\n") if SPACE.search(x))
    of = lambda a, b: a / b if b else 0.0
    return {"symbols": of(symbols, n_words), "bangs": of((text or "").count("!"), n_words), "capitals": of(len(re.findall("[A-Z]", text or "")), chars), "repeats": of(repeat, n_words), "same_lines": of(dup, lines)}


def plain_settings(rows, labels):
    """stratum -> {rule: cutoff} by trying every setting on every holdout."""
    names, out = list(risk_rules.RULES), {}
    held = {}
    for i, text, lang, *_ in rows:
        if i in labels and not plain_features(text)[5]:
            held.setdefault(lang, []).append((plain_ratios(text), labels[i]))
    strata = [s for s, xs in held.items() if any(q for _, q in xs)]
    for s in strata:
        n = sum(q for _, q in held[s])
        best = None
        for mask in range(1, 2 ** len(names)):
            for step in range(risk_rules.STEPS):
                cuts = {r: risk_rules.RULES[r][1][step] for i, r in enumerate(names) if mask >> i & 1}
                hit = [q for x, q in held[s] if any(x[r] > c for r, c in cuts.items())]
                k, p = sum(hit), risk_rules.RISK
                tail = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                if tail > risk_rules.DELTA / (2 ** len(names) - 1) / len(strata):
                    break
                rank = (len(hit) - k, -k, -step, -mask)
                if best is None or rank > best[0]:
                    best = (rank, cuts)
        if best:
            out[s] = best[1]
    return out


def plain_mix(rows):
    """Each row as often as it is taken."""
    size = {r[0]: len(SPACE.findall(r[1])) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    targets, items = plain_targets(by), []
    key = lambda i: int(hashlib.md5(f"mix{i}".encode()).hexdigest()[:12], 16)
    for s in by:
        cum = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: key(r[0])):
            cum += size[r[0]]
            items += [((e * by[s] + cum) / targets[s], s is None, s or "", key(r[0]), e, r) for e in range(3) if size[r[0]]]
    spent, out = 0, []
    for *_, r in sorted(items, key=lambda x: x[:5]):
        spent += size[r[0]]
        if spent > sum(targets.values()) + 0.5:
            break
        out.append(r)
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    items = [say(rng.randint(12, 30)) for _ in range(5)] + ["two words"]
    texts = [say(rng.randint(55, 120)) for _ in range(420)]
    labels = {i: 1 for i in range(420)}
    texts += [" ".join(w + "%%" for w in t.split()) for t in texts[:40]]  # junk that a rule can tell
    labels |= {i: 0 for i in range(420, 460)}
    texts += [texts[3], texts[3], texts[7].replace(texts[7].split()[10], "other"), None, "", "short text", "a b c " * 60, f"{say(30)} {items[1].upper()} {say(30)}", f"{say(60)} Two, words!"]
    texts += [say(20_000), "É " + say(70)]
    rows = [(i, t, ["en", "en", None][0 if i < 460 else i % 3], [None, "s1", "s2", "s3", "s4"][i % 5], 1, "k", 7) for i, t in enumerate(texts)]
    return rows, labels, items


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_is_what_a_plain_program_makes(spark, folder):
    from tokenizers import Tokenizer

    rows, labels, items = corpus()
    cuts = plain_settings(rows, labels)
    assert cuts["en"]["symbols"] < 2
    rows = [r for r in rows if not plain_features(r[1])[5] and not any(plain_ratios(r[1])[rule] > c for rule, c in cuts.get(r[2], {}).items())]
    assert not {r[0] for r in rows} & set(range(420, 460)) and len(rows) > 400
    part = plain_components(plain_sets([r[1] for r in rows]))
    rows = [r for i, r in enumerate(rows) if part[i] == i]
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: words.findall(t.translate(ASCII_LOWER))
    windows = {tuple(w[k : k + 10]) for w in map(cut, items) for k in range(max(1, len(w) - 9))}
    rows = [r for r in rows if not any(tuple(w[k : k + n]) in windows for w in [cut(r[1])] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))]
    taken = sorted(plain_mix(rows), key=lambda r: (r[0], r[1]))
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, text, *_ in taken:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_hard_rows(spark, folder, name, stage):
    rows = docs(spark)
    rows = rows.unionByName(spark.createDataFrame([(None, "no id " * 40, "en", "s1", 1, "k", 7)], rows.schema))
    for d in (rows, rows.limit(0)):
        out = stage(spark, d, folder)
        if name == "token output":
            assert out.count() == d.count()
        else:
            assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
            assert out.join(d.select("doc_id"), out["doc_id"].eqNullSafe(d["doc_id"]), "left_anti").count() == 0
            assert name == "source mixing" or out.count() <= d.count()


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "source mixing", "token output"]
    assert corpus_pipeline.ORACLE_SQL is None
