import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gristmill.operators import chunks, cluster, components, dedup, evaluate, export, filters, gates, infer, ingest, report, skew
from gristmill.sources import files


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaders_are_those_of_one_pass(spark):
    rng = random.Random(1)
    for n in (30, 60):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
        near = defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        seen, want = set(), set()
        for v in sorted(near):
            if v not in seen:
                want.add(v)
                seen |= near[v] | {v}
        members = [(0, i, v) for i, pair in enumerate(sorted(pairs)) for v in pair]
        got = {r["v"] for r in cluster.leaders(spark.createDataFrame(members, "band int, bucket long, v long")).collect()}
        assert got == want
    none = spark.createDataFrame([], "band int, bucket long, v long")
    assert cluster.leaders(none).count() == 0


def test_campaigns_are_those_of_one_pass_over_shared_buckets(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(400)}"
        rows.append((i, rng.choice(["{}", " {} ", "{}."]).format(" ".join(w))))
    c = spark.createDataFrame(rows, "row_idx long, text string")
    _, forms = cluster.distinct_forms(c)
    sigs = {r["v"]: (r["form"], r["copies"]) for r in forms.collect()}
    keys = {r["v"]: set(enumerate(r["bands"])) for r in cluster.signatures(forms, "v", 25, 5).collect()}
    shared = {(r["band"], r["bucket"], r["v"]) for r in cluster.buckets(cluster.signatures(forms, "v", 25, 5), "v").collect()}
    assert shared == {(*k, v) for v in keys for k in keys[v] if sum(k in other for other in keys.values()) > 1}
    seen, found = set(), []
    for v in sorted(keys):
        if v not in seen:
            near = [u for u in keys if keys[u] & keys[v]]
            seen |= set(near)
            found.append((sum(sigs[u][1] for u in near), v, near))
    want = {}
    for n, (size, _, near) in enumerate(sorted((f for f in found if f[0] >= 5), key=lambda f: (-f[0], f[1]))):
        for i, text in rows:
            if any(sigs[u][0] == " ".join(text.strip(" .").split()) for u in near):
                want[i] = (n, size)
    got = {r["row_idx"]: (r["campaign_id"], r["campaign_size"]) for r in cluster.campaigns(c).collect()}
    assert got == want and len(want) > 20
    every = cluster.with_campaigns(c, cluster.campaigns(c)).collect()
    assert len(every) == 90 and {r["row_idx"] for r in every if r["campaign_id"] is None} == set(range(90)) - set(want)


def test_hot_keys_are_joined_in_groups(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 5)], "k long, v long")
    got = {(r["k"], r["v"]): r["m"] for r in skew.with_least(rows, ["k"], "v", "m").collect()}
    assert got == {(1 if i % 3 else i, i): 1 if i % 3 else i for i in range(300)}
    table = spark.createDataFrame([(1, "a"), (3, "b")], "k long, x string")
    assert sorted((r["v"], r["x"]) for r in skew.lookup(rows, table, ["k"], "v").collect()) == sorted([(i, "a") for i in range(300) if i % 3] + [(3, "b")])
    assert skew.lookup(rows, table, ["k"], "v", "left").count() == 301


def test_campaigns_find_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    letter = " ".join(word() for _ in range(60))
    rows = [(i, letter if i < 6 else letter + f" {word()}" if i < 8 else " ".join(word() for _ in range(60))) for i in range(20)]
    got = {r["row_idx"]: (r["campaign_id"], r["campaign_size"]) for r in cluster.campaigns(spark.createDataFrame(rows, "row_idx long, text string")).collect()}
    assert got == {i: (0, 8) for i in range(8)}


def test_dedup(spark):
    rows = spark.createDataFrame([(0, "a", "Hi "), (1, "b", "hi"), (2, "c", "yo")], "row_idx long, id string, text string")
    got = {r["rep"]: (r["total_count"], r["is_unique"], r["duplication_ratio"]) for r in dedup.groups(rows).collect()}
    assert got == {0: (2, False, "1/1"), 2: (1, True, "1/3")}
    assert sorted(tuple(r) for r in dedup.members(rows).collect()) == [(0, "a", 0, 2), (1, "b", 0, 2), (2, "c", 2, 1)]
    told = dedup.spread(rows, dedup.representatives(rows).where("text_key = 'hi'").withColumn("analysis", F.lit("x")))
    assert {r["row_idx"]: r["analysis"] for r in told.collect()} == {0: "x", 1: "x", 2: None}


def test_longest_common_run():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(2))
        want = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
        assert dedup.longest_common(a, b) == want


def test_quotes(spark):
    rows = [("exact words", "the EXACT words here"), ("", "x"), ("q", ""), ("abcdefghij", "xxabcdefgxx"), ("abcdefghij", "abc")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, s string")
    got = [tuple(r) for r in dedup.check_quotes(df, "q", "s").orderBy("i").select("valid", "score").collect()]
    assert got == [(True, 1.0), (True, 0.0), (False, 0.0), (True, 0.7), (False, 0.3)]


def test_localize(spark):
    rows = spark.createDataFrame([(2, "Ann", "", "we in Ohio", "Ann", "in Ohio", "OH"), (2, "Bob", "", "text", "Ann", "in Ohio", "OH"), (1, "Bob", "", "text", "Ann", "", "")], "total_count int, submitter string, organization string, text string, entity_name string, state_quote string, state_identified string")
    got = [tuple(r)[4:] for r in dedup.localize(rows, F.concat_ws(" ", "submitter", "organization", "text")).collect()]
    assert got == [("Ann", "in Ohio", "OH"), ("", "", ""), ("Ann", "", "")]


def test_ids_and_guard(spark):
    rows = spark.createDataFrame([(0, "x", "T1"), (1, "x", "T2"), (2, "x", ""), (3, "y", "")], "row_idx long, id string, tracking string")
    assert [r["id"] for r in ingest.distinct_ids(rows).orderBy("row_idx").collect()] == ["x", "x#T2", "x#dup3", "y"]
    assert ingest.guard_by_share(rows, "tracking").count() == 4
    assert ingest.guard_by_share(rows, "tracking", 0.4).count() == 2


@pytest.mark.parametrize("cap", [1, 50, 121, 1000])
@pytest.mark.parametrize("block", [1, 7, 65536])
def test_byte_chunks(spark, cap, block):
    lines = [("é" * (i * 7 % 30 + 1)) for i in range(60)]
    got = chunks.byte_chunks(spark.createDataFrame(list(enumerate(lines)), "row_idx long, line string"), "line", "row_idx", cap, block, fan=3).orderBy("row_idx").collect()
    chunk, used, want = 0, 0, []
    for x in lines:
        n = len(x.encode()) + 1
        if used and used + n > cap:
            chunk, used = chunk + 1, 0
        used += n
        want.append(chunk)
    assert [r["chunk"] for r in got] == want


@pytest.mark.parametrize("n", [0, 3, 10, 1250])
def test_shards(spark, n):
    rows = spark.range(n).select((F.col("id") * 3).alias("row_idx"), F.concat(F.lit("c"), F.col("id")).alias("id"), F.lit("v").alias("f"))
    got = report.shards(rows, ["f"]).orderBy("shard").collect()
    assert [r["n"] for r in got] == [500] * (n // 500) + ([n % 500] if n % 500 else [])
    assert sum((list(json.loads(r["body"])) for r in got), []) == [f"c{i}" for i in range(n)]


def corpus(spark, **n):
    rows = []
    for k, m in n.items():
        start = len(rows)
        tags = {"O": ["Position: Oppose"], "S": ["Position: Support"], "E": []}[k[0]]
        rows += [(f"{k}{start + i}", (tags, None)) for i in range(m)]
    return spark.createDataFrame(rows, "id string, analysis struct<stances:array<string>,verified_stance:string>")


def test_gate(spark):
    old = corpus(spark, O1=940, S1=60)
    assert gates.problems(old.unionByName(corpus(spark, O2=95, S2=5)), old) == []
    assert any("new comments" in p for p in gates.problems(old.unionByName(corpus(spark, S2=100)), old))
    assert gates.problems(old.unionByName(corpus(spark, S2=10)), old) == []
    assert any("no stance" in p for p in gates.problems(corpus(spark, O1=950, E1=50), corpus(spark, O1=1000)))
    assert any("overall" in p for p in gates.problems(corpus(spark, O1=980, S1=20), old))
    assert gates.problems(corpus(spark, S1=1000), corpus(spark, O1=1000), gates.GateLimits(enabled=False)) == []
    assert gates.problems(corpus(spark, O1=500), old.limit(0)) == []
    same = corpus(spark, O1=990, S1=10)
    assert gates.problems(same, same) == []
    assert gates.problems(same, same, published={"Oppose": 94, "Support": 5, "none": 0.4, "other": 0.6})


def test_save_guard(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"))
    gates.save_guarded(table(1000), path)
    with pytest.raises(gates.Refused):
        gates.save_guarded(table(5), path)
    assert spark.read.parquet(path).count() == 1000
    gates.save_guarded(table(800), path)
    gates.save_guarded(table(5), path, force=True)
    gates.save_guarded(table(2), path)
    assert spark.read.parquet(path).count() == 2


def test_changelog(tmp_path):
    p = tmp_path / "c.json"
    assert gates.published_baseline(p) == {}
    assert gates.record_publish(10, p, {"Oppose": 94.12345})
    before = p.read_bytes()
    assert not gates.record_publish(10, p, {"Oppose": 1.0}) and p.read_bytes() == before
    assert gates.record_publish(12, p, {"Oppose": 95.0}) and len(json.loads(p.read_text())["entries"]) == 2
    assert gates.published_baseline(p) == {"Oppose": 95.0}


@pytest.mark.parametrize("scheme", ["balanced", "sqrt"])
def test_allocate(scheme):
    rng = random.Random(2)
    for _ in range(200):
        counts = {f"k{i}": rng.choice([0, 1, 5, 50, 500]) for i in range(rng.randint(1, 6))}
        size, floor = rng.randint(1, 200), rng.randint(0, 20)
        got = evaluate.allocate(counts, size, scheme, floor)
        assert all(0 <= got[k] <= counts[k] for k in got)
        lows = sum(min(floor, n) for n in counts.values())
        if lows <= size:
            assert sum(got.values()) == min(size, sum(counts.values()))


@pytest.mark.parametrize("scheme", ["balanced", "sqrt"])
def test_allocation_levels_one_by_one(scheme):
    rng = random.Random(3)
    for _ in range(500):
        counts = {f"k{i}": rng.choice([0, rng.randint(1, 30), rng.randint(1, 2000)]) for i in range(rng.randint(0, 6))}
        size, floor = rng.randint(0, 600), rng.choice([0, 5, 40])
        live = {k: n for k, n in counts.items() if n}
        weight = {k: n**0.5 if scheme == "sqrt" else 1.0 for k, n in live.items()}
        want = {k: min(n, max(min(floor, n), round(size * weight[k] / sum(weight.values())))) for k, n in live.items()}
        while live and (gap := size - sum(want.values())):
            room = {k: live[k] - want[k] if gap > 0 else want[k] - min(floor, live[k]) for k in live}
            best = max(room, key=lambda k: room[k])
            if not room[best]:
                break
            want[best] += 1 if gap > 0 else -1
        assert evaluate.allocate(counts, size, scheme, floor) == want


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a", 2.0), ("a", "b", 1.0), ("b", "b", 1.0), ("c", "a", 1.0)], "truth string, pred string, weight double")
    got = {r["class"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) for r in evaluate.class_metrics(rows, weight=F.col("weight")).collect()}
    assert got["a"][:3] == (2.0, 1.0, 1.0) and got["b"][:3] == (1.0, 1.0, 0.0) and got["c"] == (0.0, 0.0, 1.0, None, 0.0)


def test_match_source(spark):
    src = spark.createDataFrame([(0, "x", "T0", "p"), (1, "x", "T1", "q"), (2, "x", "T2", "q"), (3, "y", "", "z")], "src_idx long, id string, tracking string, text string")
    com = spark.createDataFrame([(0, "x", "q"), (1, "x#T2", "q"), (2, "x#dup3", "other"), (3, "y", "z")], "row_idx long, id string, text string")
    assert dict(export.match_source(com, src).select("row_idx", "src_idx").collect()) == {0: 1, 1: 2, 2: 0, 3: 3}


def test_wide_export_refuses_clashes(spark):
    df = spark.createDataFrame([("1", ["a", "b"])], "id string, l array<string>")
    assert export.wide(df, {"my list": F.col("l")}, ["id"]).first()["my_list"] == "a | b"
    with pytest.raises(ValueError):
        export.wide(df, {"id": F.col("l")}, ["id"])


def test_filters_round_trip(spark):
    spec = filters.FilterSpec({"q": ("contains", "text"), "d": ("dates", "day"), "e": ("one_of", "kind"), "f": ("flag", "flag"), "s": ("any_of", "tags")})
    state = filters.parse("?q=Abc&d=2024-02-01..2024-01-01&e=x&e=y&unknown=1&f=No", spec)
    assert state["d"] == ["2024-01-01..2024-02-01"] and "unknown" not in state
    assert filters.parse(filters.to_query(state), spec) == state
    rows = spark.createDataFrame([("xABCx", "2024-01-15", "x", False, ["t"]), ("abc", "2024-03-01", "x", False, []), ("abc", "2024-01-15", "z", None, [])], "text string, day string, kind string, flag boolean, tags array<string>")
    assert rows.where(filters.predicate(state, spec)).count() == 1
    assert rows.where(filters.predicate({}, spec)).count() == 3
    assert rows.where(filters.predicate(filters.parse("d=2024-02-01..", spec), spec)).count() == 1


def test_signers(spark):
    block = "Sincerely,\nAnn Lee\nUnited States Senator\nBob Roe\nUnited States Senator\nPage 1 of 2\n4 Id. at p. 10."
    chunks = "Ann Lee\nMayor\n\nBob Roe\nSheriff\n\nCy Poe\nClerk"
    df = spark.createDataFrame([(0, block), (1, chunks), (2, "We 323 organizations ask\nAnn"), (3, None)], "i int, b string")
    got = {r["i"]: (r["names"], r["count"]) for r in infer.signers(df, "b").collect()}
    assert got[0] == (["Ann Lee", "Bob Roe"], 2)
    assert got[1] == (["Ann Lee", "Bob Roe", "Cy Poe"], 3)
    assert got[2][1] == 323 and got[3] == ([], 0)


def plain_place(text, quote, last):
    if quote in text:
        return (text.rindex(quote) if last else text.index(quote)), len(quote)
    found = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, quote.split())), text)] if quote.split() else []
    return (found[-1 if last else 0][0], found[-1 if last else 0][1] - found[-1 if last else 0][0]) if found else None


def test_quote_places(spark):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice(["a", "b", ".", "\\E", "\\Q", " ", "\n", "\t ", "\xa0", "𝕏"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 25)), say(rng.randint(1, 5))) for i in range(600)] + [(600, "a  b\nc", "b c"), (601, "a  a  a", "a a")]
    got = spark.createDataFrame(rows, "i int, t string, q string").select("i", infer.quote_place(F.col("t"), F.col("q")).alias("x"), infer.quote_place(F.col("t"), F.col("q"), last=True).alias("y")).collect()
    for r in got:
        _, text, quote = rows[r["i"]]
        assert (tuple(r["x"]) if r["x"] else None) == plain_place(text, quote, False)
        assert (tuple(r["y"]) if r["y"] else None) == plain_place(text, quote, True)


def test_signer_block(spark):
    text = "Intro Ann Lee.\nWe ask.\nAnn Lee\nOrg A\nBob Roe\nOrg A\nend of it"
    far = "S\nOrg A\n" + "x" * 600 + "\nOrg A\n"
    rows = [(0, text, "Ann Lee", "Org A"), (1, text, "Nobody", "Org A"), (2, text, "", "Org A"), (3, None, "a", "b"), (4, far, "S", "Org A"), (5, "A\n1\r\nB\n \n1\nC\nb \x0b rest", "A", "B")]
    got = {r["i"]: r["block"] for r in infer.slice_blocks(spark.createDataFrame(rows, "i int, t string, a string, b string"), "t", "a", "b").collect()}
    assert got == {0: "Ann Lee\nOrg A\nBob Roe\nOrg A\n", 1: "", 2: "", 3: "", 4: "S\nOrg A", 5: "A\n1\r\nB\n \n1\nC\nb \x0b"}


def test_html_and_rules():
    assert files.html_to_text("<p>Hi<script>x()</script></p><b> there </b>") == "Hi\nthere"
    xml = "<R><AMDPAR>Revise.</AMDPAR><SECTION><SECTNO>Part</SECTNO></SECTION><SECTION><SECTNO>§ 200.1</SECTNO><SUBJECT>Def.</SUBJECT><P>One  two</P></SECTION><SECTION><SECTNO>§ 180.2</SECTNO></SECTION></R>"
    got = files.rule_sections(xml)
    assert [(s["number"], s["amendment"]) for s in got] == [("200.1", "Revise."), ("180.2", "")]
    assert [s["number"] for s in files.rule_sections(xml, "180")] == ["180.2"]


def test_attachments(spark):
    rows = [(1, 0, "attachment_1_Letter.pdf", "from pdf"), (1, 1, "attachment_2_letter.docx", " from docx "), (1, 2, "attachment_3_scan.png", None), (1, 3, "attachment_4_x.docx", ""), (1, 4, "attachment_5_x.pdf", "y")]
    g = files.attachment_groups(spark.createDataFrame(rows, "doc int, pos int, filename string, text string"))
    got = {r["stem"]: (r["chosen"], r["failed"], r["skipped"]) for r in g.collect()}
    assert got == {"letter": ("attachment_2_letter.docx", 0, 1), "scan": (None, 1, 0), "x": ("attachment_5_x.pdf", 1, 0)}
    assert files.attachment_text(g).first()["attachment_text"] == "from docx\n\n--- ATTACHMENT ---\n\ny"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Document ID,"Name, full",Comment\n1,x,"line\n""two"""\n')
    got = files.read_export(spark, str(tmp_path / "a.csv"), ["Document ID", "Name, full", "Comment"]).first()
    assert tuple(got) == (0, "1", "x", 'line\n"two"')
    (tmp_path / "r.json").write_text('{"comments": [{"id": "a"}, {"id": "b"}]}')
    assert files.read_results(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "l.jsonl").write_text('{"k": "a", "n": 1}\nbroken\n{"k": "a", "n": 2}\n')
    log = files.read_log(spark, str(tmp_path / "l.jsonl"), "k string, n int")
    assert [tuple(r) for r in infer.read_log(log, "k", "n").collect()] == [("a", 2)]
    (tmp_path / "ids.json").write_text('{"comments": [{"document_id": "D1"}]}')
    assert files.read_ids(spark, str(tmp_path / "ids.json")).first()["id"] == "D1"
    with pytest.raises(FileNotFoundError):
        files.read_ids(spark, str(tmp_path / "none.json"))


def test_streaming(spark, tmp_path):
    from gristmill.streaming.incremental import ingest_new

    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    rows = spark.range(10).select("id", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,id)").alias("ts"))
    rows.write.parquet(src)
    assert ingest_new(spark, src, out, state) == 10
    rows.union(rows.withColumn("id", F.col("id") + 10)).write.mode("append").parquet(src)
    assert ingest_new(spark, src, out, state) == 20
