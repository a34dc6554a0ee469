"""Pages, evaluation sets, remote records, attachments and sinks, on small tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill import config
from gristmill.operators import export, flags, gates, infer, ingest, pages, report, score
from gristmill.sources import attachments, files, remote, sinks
from gristmill.streaming import incremental


def test_guards(spark):
    with pytest.raises(pages.Incomplete, match="received"):
        pages.need_columns(spark.range(1), "id", "received")
    with pytest.raises(pages.Incomplete):
        pages.need_rule_page(True, [])
    pages.need_rule_page(False, None)
    rows = spark.createDataFrame([("a", "RateLimitError: insufficient_quota"), ("b", "")], "id string, analysis_error string")
    with pytest.raises(gates.Refused):
        gates.credential_block(rows)
    gates.credential_block(rows.where("id = 'b'"))
    assert gates.sample_folder("/x/", None) == ("/x/", True) and gates.sample_folder("/x/", 5) == ("/x/samples/n5-seed42", False)


def test_changelog_is_newest_first(tmp_path):
    state = gates.changelog_state({}, 10, {"Oppose": 94.12345}, "2024-01-01")
    state = gates.changelog_state(state, 12, None, "2024-01-02")
    assert [e["date"] for e in state["entries"]] == ["2024-01-02", "2024-01-01"] and state["last_shares"] == {"Oppose": 94.123}
    assert gates.changelog_state(state, 12, {"Oppose": 1.0}, "2024-01-03") is None
    assert [e["note"] for e in pages.merged_changelog([{"date": "2024-01-01", "note": "m"}, "junk"], [{"date": "2024-01-02", "note": "a"}, {"date": "2024-01-01", "note": "b"}])] == ["a", "m", "b"]


def test_field_meta():
    assert pages.field_meta([{"name": "x", "type": "text"}]) == {"x": {"label": "x", "type": "text", "show": []}}
    meta = pages.field_meta(None, show_state=True)
    assert meta["state_identified"]["show"] == ["column", "filter"] and meta["political_affiliation"]["show"] == [] and len(meta) == 9


def test_embedded_ids_and_pages(spark):
    rows = spark.createDataFrame([(i, f"c{i}", ["b", "", None, "a"][i % 4]) for i in range(8)], "row_idx int, id string, v string")
    assert pages.embedded_ids(rows, 7) is None and len(pages.embedded_ids(rows, 8)) == 8
    order = lambda **k: [r["row_idx"] for r in pages.table_page(rows, "v", **k).collect()]
    assert order(size=4) == [3, 7, 0, 4] and order(size=4, page=2) == [1, 5, 2, 6] and order(size=2, descending=True) == [0, 4]


def test_labels_and_agreement(spark):
    rows = spark.createDataFrame([("unclear_junk", "Position: Oppose the rule", "x"), (" oppose", "Position: Oppose", "2.5"), ("", "(none)", "1"), ("no_position", "(none)", None)], "label string, pipeline_label string, weight string")
    rows = rows.withColumn("pipeline_norm", score.short_name(F.col("pipeline_label")))
    assert [r["pipeline_norm"] for r in rows.collect()] == ["oppose", "oppose", "no_position", "no_position"]
    got = score.labelled(rows).orderBy("weight").collect()
    assert sorted((r["truth"], r["pred"], r["weight"]) for r in got) == [("no_position", "no_position", 1.0), ("no_position", "oppose", 1.0), ("oppose", "oppose", 2.5)]
    assert score.agreement(score.labelled(rows)).first()["agreement"] == pytest.approx(2 / 3)
    named = score.labelled(rows.withColumn("id", F.lit("i")).withColumn("text", F.lit("t" * 2000)))
    document = score.score_document(score.score(named, named.select("pred")), 3, model="m")
    assert document["model"] == "m" and document["unreadable"] == 3 and len(document["rows"]) == 3 and len(document["rows"][0]["text"]) == 1500
    cell = score.accuracy_rows(named, cell=("no_position", "oppose"))
    assert cell.count() == 1 and score.accuracy_rows(named, "mismatch").count() == 1 and score.accuracy_rows(named, "agree", contains="OPPOSE").count() == 1
    assert score.stages([{"name": "first"}], {"first": [{"p": 1}]}, 3, 1)[-1]["about"].startswith("1 of 3")


def test_texts_that_are_judged(spark):
    row = spark.createDataFrame([("See attached", "a long letter " * 5), ("short", ""), ("x" * 70, "att")], "b string, a string")
    got = [r[0] for r in row.select(score.audit_text(F.col("b"), F.col("a"))).collect()]
    assert got[0].startswith("See attached || ATTACHMENT: a long letter") and got[1:] == [None, "x" * 70]
    assert row.select(score.judged_text(F.col("b"), F.col("a"))).first()[0].startswith("See attached --- ATTACHMENT CONTENT --- a long")


def test_review_sheet(spark):
    drawn = spark.createDataFrame([("a", "Position: Oppose", ""), ("b", "(none)", ""), ("c", "Position: Support", "")], "id string, pipeline_label string, label string")
    drafts = spark.createDataFrame([("a", "oppose", "", "?"), ("b", "no_position", "", "")], "id string, draft_label string, what_makes_it_hard string, reviewer_should_check string")
    drafts = drafts.withColumns({f: F.lit("e") for f in score.EVIDENCE[:4]})
    got = [(r["id"], r["review_first"], r["label"]) for r in score.review_sheet(drawn, drafts).collect()]
    assert got == [("c", True, ""), ("a", True, "oppose"), ("b", False, "no_position")]


# --- exports --------------------------------------------------------------------------------------------------------


def test_matching_tells_what_is_unmatched(spark):
    source = spark.createDataFrame([(0, "A", "T1", "x"), (1, "A", "T2", "y"), (2, "A", "", "z")], "src_idx int, id string, tracking string, text string")
    c = spark.createDataFrame([(0, "A", "z"), (1, "A#T2", "other"), (2, "A", "none")], "row_idx int, id string, text string")
    got = export.match_source(c, source)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2, True), (1, 1, False), (2, 0, False)]
    assert export.check_matched(c, got) == 2
    with pytest.raises(export.Unmatched, match="1 comments.*B"):
        export.check_matched(c.unionByName(spark.createDataFrame([(9, "B", "q")], c.schema)), got)


def test_flat_cells(spark):
    row = spark.sql("select named_struct('b', 1, 'a', 'x') s, map('k', 1) m, array('p', 'q') l, true t, cast(null as string) n, 1.5D d")
    got = export.wide(row, {n: F.col(n) for n in row.columns}, []).first()
    assert tuple(got) == ('{"a":"x","b":1}', '{"k":1}', "p | q", "True", "", "1.5")
    with pytest.raises(ValueError, match="clash"):
        export.wide(row, {"a b": F.lit(1), "a_b": F.lit(2)}, [])


# --- lists and flags ------------------------------------------------------------------------------------------------


def test_id_lists_with_notes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["x", "", "y"]))
    assert sorted(r["id"] for r in files.read_ids(spark, str(tmp_path / "a.json")).collect()) == ["x", "y"]
    records = [{"document_id": "x", "reason": "", "text": "one  two three"}, {"document_id": "y", "reason": "spam"}, {"document_id": "gone", "reason": "late"}]
    (tmp_path / "b.json").write_text(json.dumps({"comments": records}))
    ids = files.read_ids(spark, str(tmp_path / "b.json"), ["reason", "text"], 9)
    assert {r["id"]: r["note"] for r in ids.collect()} == {"x": "one two…", "y": "spam", "gone": "late"}
    kept = flags.kept_ids(ids, "reason", ["SPAM"])
    rows = spark.createDataFrame([("x#T1",), ("y",), ("z",)], "id string")
    got = {r["id"]: (r["f"], r["f_note"]) for r in flags.listed(rows, kept, "f", notes=True).collect()}
    assert got == {"x#T1": (True, "one two…"), "y": (False, ""), "z": (False, "")}
    told = flags.coverage(flags.listed(rows, kept, "f"), kept, "f", "Withdrawn.").first()
    assert (told["listed"], told["shown"]) == (2, 1) and told["description"].startswith("Withdrawn. Of 2 on record, 1")
    with pytest.raises(FileNotFoundError):
        files.read_ids(spark, str(tmp_path / "none.json"))


def test_small_documents(spark, tmp_path):
    p = str(tmp_path / "d.json")
    assert files.read_document(spark, p) is None and files.read_metadata(spark, p, {"a": "1"}) == {"a": "1"}
    sinks.write_document(spark, p, {"a": "2", "b": ""})
    assert files.read_document(spark, p) == {"a": "2", "b": ""} and files.read_document(spark, p, list) is None and files.read_metadata(spark, p, {"a": "1", "b": "x"}) == {"a": "2", "b": "x"}
    sinks.write_text(spark, p, "{broken")
    assert files.read_document(spark, p) is None
    sinks.write_ids(spark.createDataFrame([("b",), ("a",)], "id string"), p)
    assert files.read_document(spark, p, list) == ["a", "b"]


def test_exports_have_row_numbers(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "".join(f'{name}{i},"line ""q""\nmore"\n' for i in range(n)))
    got = [(r["row_idx"], r["x"]) for r in files.read_export(spark, str(tmp_path), ["x", "y"]).orderBy("row_idx").collect()]
    assert got == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0"), (4, "b1")]
    few = files.read_export(spark, str(tmp_path), ["x", "y"], first=4).orderBy("row_idx").collect()
    assert [r["x"] for r in few] == ["a0", "a1", "a2", "b0"] and few[0]["y"] == 'line "q"\nmore'


def test_labelled_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,label,weight\na,oppose,2\nb,,3\nc, x ,none\n")
    assert [(r["id"], r["weight"]) for r in files.read_labelled(spark, str(tmp_path / "s.csv")).collect()] == [("a", 2.0), ("c", 1.0)]


def test_nested_paragraphs_of_rules():
    xml = "<R><SECTION><SECTNO>§ 200.1</SECTNO><P>One</P><EXTRACT><P>Two  words</P></EXTRACT></SECTION></R>"
    assert files.rule_sections(xml)[0]["text"] == "One\n\nTwo words"


# --- attachments ----------------------------------------------------------------------------------------------------


def docx(paragraphs, rows=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{table}{''.join(map(p, paragraphs))}</w:body></w:document>")
    return out.getvalue()


def test_files_by_format(spark):
    class Reads:
        def read(self, content, extension):
            return "EMPTY" if content == b"blank" else f"seen {extension} {len(content)}"

    rows = [(1, "a.TXT", b"plain words here"), (2, "b.html", b"<p>Hi <b>there</b></p><script>x</script> all of you"), (3, "c.docx", docx(["First line", "Second"], [["Ann", "Org"], ["", ""]])), (4, "d.png", b"pic"), (5, "e.gif", b"blank"), (6, "f.pdf", b"%PDF"), (7, "g.docx", b"broken"), (8, "h.txt", b"\x01\x02\x03" * 9), (9, "i.txt", None)]
    df = spark.createDataFrame([(d, 1, n, c) for d, n, c in rows], "doc int, pos int, filename string, content binary")
    got = {r["doc"]: (r["text"], r["reason"]) for r in attachments.extracted(df, ocr=Reads()).collect()}
    assert got[1] == ("plain words here", "") and got[2] == ("Hi there all of you", "") and got[3] == ("First line\nSecond\nAnn Org", "") and got[4] == ("seen .png 3", "")
    assert [got[i][1] for i in (5, 6, 7, 8, 9)] == ["no text extracted", "no reader", "unreadable: BadZipFile", "gibberish", "no text extracted"] and not got[8][0]
    assert {r["doc"]: r["reason"] for r in attachments.extracted(df).collect()}[4] == "no client for pictures"


def test_cache_is_read_through(spark):
    f = spark.createDataFrame([(1, "a.txt", b"from the file"), (1, "b.txt", b"also from the file"), (2, "attachment_1_c.txt", b"third file text")], "doc int, filename string, content binary")
    cache = spark.createDataFrame([(1, "a.txt", "cached"), (1, "b.txt", " ")], "doc int, filename string, text string")
    told, fresh = attachments.read_through(f, cache, attachments.extracted)
    assert sorted(r["text"] for r in told.collect()) == ["also from the file", "cached", "third file text"] and fresh.count() == 2
    assert {r["doc"]: r["complete"] for r in attachments.warmed(f, cache).collect()} == {1: False, 2: False}
    assert {r["doc"]: r["complete"] for r in attachments.warmed(f, told).collect()} == {1: True, 2: True}
    merged = attachments.merged_caches(cache, spark.createDataFrame([(1, "a.txt", "remote"), (1, "b.txt", "remote")], cache.schema))
    assert sorted(r["text"] for r in merged.collect()) == ["cached", "remote"]
    assert attachments.refreshed(cache, fresh, [1]).count() == 2


def test_names_and_failures(spark):
    rows = spark.createDataFrame([(1, " http://h/x/Letter.docx, http://h/x/Letter.pdf,,http://h/y/scan")], "doc int, urls string")
    named = attachments.attached_files(rows, "urls")
    assert [r["filename"] for r in named.orderBy("pos").collect()] == ["attachment_1_Letter.docx", "attachment_2_Letter.pdf", "attachment_4_scan.pdf"]
    f = named.withColumn("text", F.when(F.col("pos") == 2, "t").otherwise("")).withColumn("reason", F.when(F.col("pos") == 2, "").otherwise("no reader"))
    assert sorted((r["filename"], r["reason"]) for r in attachments.failures(f).collect()) == [("attachment_1_Letter.docx", "no reader"), ("attachment_4_scan.pdf", "all formats empty"), ("attachment_4_scan.pdf", "no reader")]
    kinds = spark.createDataFrame([("Public Submission", "u"), ("Public Submission", ""), ("Notice", "u")], "k string, u string")
    assert attachments.with_attachments(kinds, "k", "u").count() == 1


# --- remote records -------------------------------------------------------------------------------------------------


def service(path):
    i = path.split("/")[1]
    if i == "spent":
        raise remote.Failed(429)
    attributes = {"withdrawn": i == "w", "comment": f"text {i}", "duplicateComments": 0, "postedDate": "2024-01-02T05:00:00Z", "receiveDate": "2024-01-01T05:10:00Z", "displayProperties": [{"name": "n", "label": "l"}], "reasonWithdrawn": "asked" if i == "w" else None}
    return json.dumps({"data": {"attributes": attributes}, "included": [{"attributes": {"fileFormats": [{"fileUrl": "u1"}, {"fileUrl": "u2"}]}}, {"attributes": {"fileFormats": None}}]}).encode()


def test_calls_are_tried_again():
    said, waited = [remote.Failed(503), remote.Failed(429), b'{"a": 1}'], []

    def busy(path):
        x = said.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.call(busy, "p", sleep=waited.append) == {"a": 1} and waited == [5, 10]
    for states, error in (([429] * 3, remote.RateLimited), ([500] * 3, remote.Failed), ([404], remote.Failed)):
        said[:] = [remote.Failed(s) for s in states]
        with pytest.raises(error):
            remote.call(busy, "p", sleep=waited.append)


def test_details_are_export_rows(spark):
    ids = spark.createDataFrame([("a",), ("w",), ("spent",), ("z",)], "id string")
    got = remote.fetch_details(ids, "tests.test_pages:service")
    assert sorted((r["id"], r["body"] is None) for r in got.collect()) == [("a", False), ("spent", True), ("w", True), ("z", True)]
    rows = remote.detail_rows(remote.fetch_details(ids.where("id in ('a', 'w')"), "tests.test_pages:service"))
    r = {x["Document ID"]: x for x in rows.collect()}["a"]
    assert (r["Is Withdrawn?"], r["Duplicate Comments"], r["Posted Date"], r["Received Date"], r["Attachment Files"], r["Comment"]) == ("false", "", "2024-01-02T05:00Z", "2024-01-01T05:10:00Z", "u1,u2", "text a")
    assert r[remote.DISPLAY] == "n, l, " and r["City"] == ""
    export_rows = rows.withColumn("Comment", F.lit("had")).withColumn("Is Withdrawn?", F.when(F.col("`Document ID`") == "a", "TRUE").otherwise("false"))
    old = remote.already_withdrawn(export_rows, "2024-02-01")
    new = remote.newly_withdrawn(rows, export_rows, "2024-02-02")
    record = remote.with_records(old, new)
    assert [(x["id"], x["text_available"], x["text"], x["reason"]) for x in remote.with_records(record, new).collect()] == [("a", False, "", ""), ("w", True, "had", "asked")]


def test_marks_and_missing_ids(spark):
    listed = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-03"), ("c", None)], "id string, modified string")
    assert remote.next_mark(listed, "2024-01-02", True) == "2024-01-03" and remote.next_mark(listed, "2024-01-02", False) == "2024-01-02"
    assert [r["id"] for r in remote.missing_ids(listed, listed.where("id = 'b'"), limit=1).collect()] == ["a"]
    assert tuple(remote.local_counts(listed.withColumnRenamed("modified", "posted"), "2024-01-03").first()) == (3, 1)
    t = spark.createDataFrame([("2024-01-02T03:04:05Z",)], "t string").select(incremental.to_cursor(F.col("t")).alias("c"))
    assert t.select("c", incremental.from_cursor(F.col("c"))).first()[:] == ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z")


# --- sinks ----------------------------------------------------------------------------------------------------------


def test_state_is_pushed_and_pulled(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    with pytest.raises(gates.Refused):
        sinks.push(spark, a, b)
    sinks.write_text(spark, a, "x" * 100)
    sinks.push(spark, a, b)
    sinks.write_text(spark, a, "x" * 80)
    with pytest.raises(gates.Refused):
        sinks.push(spark, a, b)
    sinks.push(spark, a, b, force=True)
    assert files.read_whole(spark, b) == "x" * 80


def test_chunks_are_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(20)], "row_idx long, line string")
    sinks.write_chunks(rows, str(tmp_path / "c"), "line", "row_idx", cap=30)
    text = [p.read_text() for d in sorted((tmp_path / "c").glob("chunk=*"), key=lambda d: int(d.name[6:])) for p in d.glob("part-*")]
    assert "".join(text) == "".join(f"line {i}\n" for i in range(20)) and all(len(t) <= 30 for t in text)
    assert sinks.snapshot(rows, str(tmp_path / "r")).endswith("r.inprogress") and files.count_rows(spark, str(tmp_path / "r.inprogress")) == 20
    assert files.read_stored(spark, str(tmp_path / "r.inprogress"), "row_idx long, other string").where("other is null").count() == 20


def test_deletes_name_columns_only():
    assert sinks.delete_statement("s.comments", "docket_id") == "DELETE FROM s.comments WHERE docket_id = ?"
    with pytest.raises(ValueError):
        sinks.delete_statement("x; drop", "k")


def test_run_counts(spark):
    rows = spark.createDataFrame([("a", "Public Submission", ""), ("a#2", "Notice", "e"), ("b", None, "")], "id string, kind string, err string")
    seen, told = ingest.counted(rows.withColumn("later", F.col("id").contains("#")), "kind", error="err", repeated="later")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    seen.write.format("noop").mode("overwrite").save()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == len(before) + 1  # the write alone
    assert told.get == {"rows": 3, "other_kinds": 2, "repeated_ids": 1, "failed": 1}


def test_later_rows_of_an_id_are_marked_and_an_own_hash_is_none(spark):
    rows = spark.createDataFrame([(0, "a", ""), (1, "a", "T"), (2, "x#1", ""), (3, "a", None), (4, None, ""), (5, None, "")], "row_idx long, id string, tracking string")
    got = {r["row_idx"]: (r["id"], r["later"]) for r in ingest.distinct_ids(rows, mark="later").collect()}
    assert got == {0: ("a", False), 1: ("a#T", True), 2: ("x#1", False), 3: ("a#dup3", True), 4: (None, False), 5: (None, True)}
    seen, told = ingest.counted(ingest.distinct_ids(rows, mark="later"), repeated="later")
    assert seen.count() == 6 and told.get["repeated_ids"] == 3


def test_ids_are_given_where_there_is_none(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, " ", "y"), (2, None, ""), (3, None, None)], "row_idx long, a string, b string")
    assert [r["id"] for r in ingest.with_id(rows, "a", "b").orderBy("row_idx").collect()] == ["a", "y", "comment_2", "comment_3"]


def test_samples_are_the_same_on_every_run(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("other"))
    first = [r["k"] for r in ingest.sample_rows(rows, 20, "k", "s").collect()]
    again = [r["k"] for r in ingest.sample_rows(rows.repartition(7), 20, "k", "s").collect()]
    assert first == again and len(set(first)) == 20 and first != [r["k"] for r in ingest.sample_rows(rows, 20, "k", "t").collect()]
    assert ingest.sample_rows(rows, 0, "k", "s").count() == 0 and ingest.sample_rows(rows, 900, "k", "s").count() == 500


def test_log_of_the_second_pass(spark):
    rows = spark.createDataFrame([("a", None, None, 1), ("b", "", None, 2), ("c", None, "OH", 3)], "id string, verified_stance string, verified_state string, n int")
    got = sinks.verification_log(rows, ["verified_stance", "verified_state"])
    assert got.columns == ["id", "verified_stance", "verified_state"] and sorted(r["id"] for r in got.collect()) == ["b", "c"]


def test_downloads_that_fail_are_told(spark):
    class Client:
        def fetch(self, url):
            if url == "gone":
                raise OSError
            return url.encode()

    got = attachments.downloaded(spark.createDataFrame([(1, "u"), (2, "gone")], "pos int, url string"), Client())
    assert {r["pos"]: r["content"] and bytes(r["content"]) for r in got.collect()} == {1: b"u", 2: None}


def test_tables_of_other_columns_are_united(spark):
    got = ingest.united([spark.range(1).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit("x"))])
    assert got.columns == ["id", "a", "b"] and got.where("b is null").count() == 1


def test_errors_of_credentials(spark):
    told = ["Invalid API key", "HTTP 429", "timed out", None, "RateLimitError: slow down", "no credits remaining", "JSONDecodeError: line 1 column 401 (char 400)", "AuthenticationError: x"]
    rows = spark.createDataFrame([(x,) for x in told], "analysis_error string")
    assert sorted(r[0] for r in infer.credential_errors(rows).collect()) == ["AuthenticationError: x", "Invalid API key", "RateLimitError: slow down", "no credits remaining"]
    for marker in infer.PUBLISH_MARKERS:
        assert infer.credential_errors(spark.createDataFrame([(f"E: {marker.upper()}!",)], "analysis_error string")).count() == 1


def test_fields_take_options_from_elsewhere():
    raw = {"stances": [{"name": "Position: Oppose"}], "entity_types": ["Business"], "fields": [{"name": "s", "type": "multi_enum", "options_from": "stances"}, {"name": "e", "type": "single_enum", "options_from": "entity_types", "default": "x"}, {"name": "t"}]}
    got = {f.name: f.options for f in config.parse(raw).fields}
    assert got == {"s": ("Position: Oppose",), "e": ("Business",), "t": ()}


def test_cards_by_count(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "place int, n int")
    assert [r["place"] for r in pages.by_count(rows).collect()] == [2, 1, 3]
    assert report.plurality  # campaign stances are tested with their query
