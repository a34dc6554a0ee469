"""Hot keys are many tasks, large files many ranges, and what breaks off goes on."""

import json
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from gristmill.operators import chunks, cluster, evaluate, export, gates, ingest, skew
from gristmill.sources import attachments, files, listing, packs, sinks
from gristmill.streaming import incremental


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


# --- hot keys -------------------------------------------------------------------------------------------------------


def test_places_in_a_hot_key_are_counted_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i * 3 - 700, rng.choice(["hot"] * 5 + ["a", None, f"k{i % 9}"]), "x" if i % 2 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "o long, k string, j string").repartition(5)
    for keys in (["k"], ["k", "j"]):
        seen, want = {}, {}
        for o, k, j in sorted(rows, key=lambda r: r[0]):
            key = (k, j)[: len(keys)]
            seen[key] = want[o] = seen.get(key, 0) + 1
        got = skew.nth(df, keys, "o", "n", block=50)
        assert {r["o"]: r["n"] for r in got.collect()} == want and got.columns == ["o", "k", "j", "n"]


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    """No task orders more rows of a key than a block has."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(6000).select(F.col("id").alias("row_idx"), F.lit("hot").alias("id"), F.lit("").alias("tracking"))
        told = skew.nth(df.repartition(3), ["id"], "row_idx", "n", block=500).withColumn("task", F.spark_partition_id())
        per = [r["count"] for r in told.groupBy("task").count().collect()]
        assert len(per) > 2 and max(per) < 6000
        assert told.agg(F.sum("n")).first()[0] == 6000 * 6001 // 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ingest.distinct_ids(df).where("id = 'hot#dup6000'").count() == 1


def test_sources_of_a_hot_id_pair_up(spark):
    c = spark.range(400).select(F.col("id").alias("row_idx"), F.lit("D").alias("id"), (F.col("id") % 3).cast("string").alias("text"))
    s = spark.range(400).select((F.col("id") + 1000).alias("src_idx"), F.lit("D").alias("id"), F.lit("").alias("tracking"), (F.col("id") % 3).cast("string").alias("text"))
    got = {r["row_idx"]: (r["src_idx"], r["same_text"]) for r in export.match_source(c, s).collect()}
    assert got == {i: (i + 1000, True) for i in range(400)}


def test_strata_are_cut_before_the_shuffle(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 25 > 0, "most").otherwise("few").alias("s"), F.lit("long text").alias("text"))
    got = evaluate.stratified(d, "s", {"most": 7, "few": 40}, "doc_id")
    assert plan(got).count("WindowGroupLimit") >= 2
    assert {r["s"]: (r["count"], r["w"]) for r in got.groupBy("s").agg(F.count("*").alias("count"), F.max("weight").alias("w")).collect()} == {"most": (7, 411.43), "few": (40, 3.0)}
    assert evaluate.stratified(d, "s", {}, "doc_id").count() == 0


def test_single_lines_of_long_letters(spark):
    from collections import Counter

    from gristmill.operators import infer

    rng = random.Random(4)
    letters = [[], ["a"], ["a", "A"], ["b", "a", "b"], ["é", "É", "x"], [f"Name {rng.randint(0, 9000)}" for _ in range(12_000)]]
    df = spark.createDataFrame(list(enumerate(letters)), "k int, lines array<string>")
    got = {r["k"]: r["once"] for r in df.select("k", infer.single_lines(F.col("lines")).alias("once")).collect()}
    for k, lines in enumerate(letters):
        n = Counter(x.lower() for x in lines)
        assert got[k] == [x for x in lines if n[x.lower()] == 1]


# --- chunks ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cap", [90, 400, 5000])
def test_maps_compose_as_rows_follow_each_other(cap):
    import numpy as np

    rng = np.random.default_rng(cap)
    sizes = rng.integers(1, 120, 3000)
    cuts = np.sort(rng.choice(np.arange(1, 3000), 40, replace=False))
    parts = np.split(sizes, cuts)
    maps = [chunks.map_of(p, cap) for p in parts]

    def fold(ms):  # in a tree of any shape
        if len(ms) == 1:
            return ms[0]
        k = int(rng.integers(1, len(ms)))
        return fold(ms[:k]).then(fold(ms[k:]), cap)

    whole, direct = fold(maps), chunks.map_of(sizes, cap)
    for used in (*range(0, cap + 1, 7), cap, cap + 50):
        begun, left = 0, used
        for n in sizes.tolist():
            if left + n > cap:
                begun, left = begun + 1, 0
            left += n
        for m in (whole, direct):
            got = m.after(np.array([used]), cap)
            assert (int(got[0][0]), int(got[1][0])) == (begun, left)
    assert len(whole.room) <= np.searchsorted(np.cumsum(sizes), cap) + 1


def test_chunks_of_rows_with_holes_and_signs(spark):
    rows = [(i * 40 - 2000, "x" * (i % 9)) for i in range(120)]
    got = {r["o"]: r["chunk"] for r in chunks.byte_chunks(spark.createDataFrame(rows, "o long, line string"), "line", "o", 20, block=64, fan=2).collect()}
    chunk, used = 0, 0
    for o, line in rows:
        if used + len(line) + 1 > 20:
            chunk, used = chunk + 1, 0
        used += len(line) + 1
        assert got[o] == chunk
    assert chunks.byte_chunks(spark.createDataFrame([], "o long, line string"), "line", "o", 20).count() == 0


def test_bands_for_a_threshold():
    assert cluster.banding(0.45) == (25, 5) and cluster.banding(0.3) == (37, 3)
    assert cluster.configured({}) == {"bands": 25, "rows": 5, "least": 5, "min_chars": 100}
    assert cluster.configured({"threshold": 0.3, "min_size": 2, "min_chars": 10}) == {"bands": 37, "rows": 3, "least": 2, "min_chars": 10}


# --- exports --------------------------------------------------------------------------------------------------------


def export_text(rng, n, end):
    def cell():
        return "".join(rng.choice(["a", "b", '"', ",", "\n", "\r\n", " ", "é", '""', 'x"y']) for _ in range(rng.randint(0, 8)))

    def quoted(c):
        return '"' + c.replace('"', '""') + '"' if rng.random() < 0.6 or any(x in c for x in '",\n\r') else c

    lines = ["id,b,c"]
    for i in range(n):
        lines += [""] * (rng.random() < 0.05)
        lines.append(",".join([str(i), 'ab"c' if rng.random() < 0.08 else quoted(cell()), quoted(cell())]))
    return end.join(lines) + end * (rng.random() < 0.5)


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\r\n")])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, seed, end):
    rng, columns = random.Random(seed), ["id", "b", "c"]
    for name in ("p0", "p1"):
        (tmp_path / f"{name}.csv").write_bytes(export_text(rng, 60, end).encode())
    want = [tuple(r) for n in ("p0", "p1") for r in spark.read.schema("id string, b string, c string").csv(f"{tmp_path}/{n}.csv", header=True, multiLine=True, escape='"').collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [tuple(r) for r in files.read_export(spark, str(tmp_path), columns).orderBy("row_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, *r) for i, r in enumerate(want)]


def test_headers_must_be_those_asked_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        files.read_export(spark, str(tmp_path), ["x", "y"])
    (tmp_path / "a.csv").write_text("\ufeffx,y\n")
    assert files.read_export(spark, str(tmp_path), ["x", "y"]).count() == 0


# --- a database -----------------------------------------------------------------------------------------------------


def test_rows_are_replaced_in_one_transaction(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    con.createStatement().execute("CREATE TABLE comments (docket VARCHAR(10) NOT NULL, id INT CHECK (id < 100), note VARCHAR(20) DEFAULT 'new')")
    con.createStatement().execute("INSERT INTO comments VALUES ('a', 1, 'old'), ('a', 2, 'old'), ('b', 3, 'old')")
    there = lambda: sorted(tuple(r) for r in spark.read.jdbc(url, "comments").collect())
    rows = lambda *ids: spark.createDataFrame([("a", i) for i in ids], "docket string, id int").repartition(2)
    sinks.replace_jdbc(rows(7, 8, 9), url, "comments", "docket", "a")
    assert there() == [("a", 7, "new"), ("a", 8, "new"), ("a", 9, "new"), ("b", 3, "old")]
    with pytest.raises(Exception, match="(?i)check constraint|comments"):
        sinks.replace_jdbc(rows(5, 500), url, "comments", "docket", "a")
    assert there() == [("a", 7, "new"), ("a", 8, "new"), ("a", 9, "new"), ("b", 3, "old")]  # the old rows are still there
    sinks.replace_jdbc(rows(), url, "comments", "docket", "a")
    assert there() == [("b", 3, "old")]
    tables = con.getMetaData().getTables(None, None, "COMMENTS%", None)
    names = []
    while tables.next():
        names.append(tables.getString("TABLE_NAME"))
    assert names == ["COMMENTS"]  # nothing is left beside it
    con.close()


def test_long_lists_are_no_documents(spark, tmp_path):
    with pytest.raises(ValueError, match="more than 5"):
        sinks.write_ids(spark.range(6).select(F.col("id").cast("string")), f"{tmp_path}/x", most=5)


# --- a listing ------------------------------------------------------------------------------------------------------


def failing(path, page_rows):
    """A service that lists a file, and breaks at its third window while a file says so."""
    import os

    fetch = listing.from_file(path, page_rows)

    def asked(since, page):
        if os.path.exists(f"{path}.broken") and since >= "2024-01-01 00:01:00":
            raise RuntimeError("service is down")
        return fetch(since, page)

    return asked


def test_a_broken_listing_goes_on(spark, tmp_path):
    rows = [{"id": f"d{i:03}", "modified": f"2024-01-01 00:{i // 2 // 60:02}:{i // 2 % 60:02}", "n": i} for i in range(300)]  # two a second
    path = tmp_path / "l.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "l.jsonl.broken").touch()
    target, state = f"{tmp_path}/target", f"{tmp_path}/state"
    listed = lambda: listing.stream_listing(spark, str(path), page_rows=11, pages=4, service="tests.test_scale:failing")
    with pytest.raises(Exception, match="service is down"):
        incremental.follow_listing(listed(), target, state)
    some = spark.read.parquet(target).count()
    assert 0 < some < 300
    (tmp_path / "l.jsonl.broken").unlink()
    assert incremental.follow_listing(listed(), target, state) == 300
    more = [{"id": "d005", "modified": "2024-01-01 00:09:00", "n": 5}, {"id": "e", "modified": "2024-01-01 00:02:29", "n": 300}, {"id": "late", "modified": "2024-01-01 00:08:00", "n": 301}]
    path.write_text("\n".join(json.dumps(r) for r in rows + more))
    assert incremental.follow_listing(listed(), target, state) == 302  # one of the last second seen, one after, one known
    got = spark.read.parquet(target)
    assert got.select("id").distinct().count() == 302 and json.loads(got.where("id = 'd007'").first()["body"]) == {"n": 7}


def test_cursors(spark):
    rows = [{"id": f"{i}", "modified": f"{i // 5:03}"} for i in range(40)]
    fetch = lambda since, page: [r for r in rows if r["modified"] >= since][(page - 1) * 4 : page * 4]
    start, seen = {"since": "", "seen": []}, []
    cursors = [start]
    while True:
        found, start = listing.window(fetch, start, 4, 3)
        if not found:
            break
        seen += [r["id"] for r in found]
        cursors.append(start)
    assert seen == [r["id"] for r in rows] and len(cursors) > 3
    for i in range(len(cursors) - 1):
        assert [r["id"] for r in listing.between(fetch, cursors[i], cursors[-1], 4, 3)] == seen[len([r for r in rows[:40]]) - len(list(listing.between(fetch, cursors[i], cursors[-1], 4, 3))) :]
    same = [{"id": f"s{i}", "modified": "t"} for i in range(40)]
    with pytest.raises(listing.Stalled):
        start = {"since": "", "seen": []}
        for _ in range(9):
            _, start = listing.window(lambda s, p: same[(p - 1) * 4 : p * 4], start, 4, 3)


# --- packed caches --------------------------------------------------------------------------------------------------

CACHE = "doc string, filename string, text string"


def cached(spark, n=60):
    rows = [(f"D-{i % 20}/x", f"file {i}.pdf", f"text {i} é\n" * (i % 9)) for i in range(n)]
    return rows, spark.createDataFrame([*rows, ("D-1", "blank.pdf", " \n"), ("D-1", "none.pdf", None)], CACHE)


def test_caches_are_packed_and_come_back(spark, tmp_path):
    rows, cache = cached(spark)
    full = [r for r in rows if r[2].strip()]
    target = f"{tmp_path}/store"
    assert packs.push(cache, target, archive_bytes=300) == len(full)
    assert len(list((tmp_path / "store").glob("*/*.tar.gz"))) > 5
    assert sorted(tuple(r) for r in packs.pull(spark, target).collect()) == sorted(full)
    local = spark.createDataFrame([(*full[0][:2], "done again here"), ("own", "a.txt", "only here"), (*full[1][:2], "")], CACHE)
    got = {(r["doc"], r["filename"]): r["text"] for r in packs.refresh(local, target).collect()}
    assert got == {r[:2]: r[2] for r in full} | {full[0][:2]: "done again here", ("own", "a.txt"): "only here"}
    with pytest.raises(gates.Refused, match="would replace"):
        packs.push(cache.limit(5), target)
    assert packs.pull(spark, target).count() == len(full)
    packs.push(cache.where("doc = 'D-7/x'"), target, force=True)
    assert packs.pull(spark, target).select("doc").distinct().count() == 1


@pytest.mark.parametrize("harm", ["empty", "gone", "short", "other"])
def test_harmed_archives_are_refused(spark, tmp_path, harm):
    target = f"{tmp_path}/store"
    packs.push(cached(spark)[1], target, archive_bytes=500)
    a, b, *_ = sorted((tmp_path / "store").glob("*/*.tar.gz"))
    if harm == "gone":
        a.unlink()
    else:
        a.write_bytes({"empty": b"", "short": a.read_bytes()[:-9], "other": b.read_bytes()}[harm])
    with pytest.raises(Exception, match="empty or absent" if harm in ("empty", "gone") else "not what was written"):
        packs.pull(spark, target)


def test_nothing_is_pushed_or_pulled(spark, tmp_path):
    with pytest.raises(gates.Refused, match="nothing to push"):
        packs.push(spark.createDataFrame([("a", "b", " ")], CACHE), f"{tmp_path}/store")
    with pytest.raises(gates.Refused, match="nothing was pushed"):
        packs.pull(spark, f"{tmp_path}/store")


# --- rules ----------------------------------------------------------------------------------------------------------


def test_sections_of_many_rules(spark):
    section = lambda no, text: f"<SECTION><SECTNO>§ {no}</SECTNO><SUBJECT>On {no}</SUBJECT><P>{text}</P><P>more</P></SECTION>"
    one = f"<RULE><AMDPAR>1. Revise</AMDPAR>{section('none', 'x')}{section('200.1', 'first')}{section('300.2', 'second')}</RULE>"
    rows = spark.createDataFrame([("a", one), ("b", f"<R>{section('200.9', 'third')}</R>"), ("c", None), ("d", " ")], "path string, xml string")
    got = [tuple(r) for r in files.sections(rows).orderBy("path", "place").collect()]
    assert [r[:3] for r in got] == [("a", 0, "200.1"), ("a", 1, "300.2"), ("b", 0, "200.9")]
    assert got[0][4:] == ("On 200.1", "1. Revise", "first\n\nmore") and got[1][5] == ""
    assert [r["number"] for r in files.sections(rows, "300").collect()] == ["300.2"]
    assert files.sections(rows.limit(0)).count() == 0


# --- scanned pages --------------------------------------------------------------------------------------------------


def test_pages_without_readable_text_are_read_by_a_client(spark):
    class Eyes:
        """Reads what a picture says, and fails or finds nothing where it says so."""

        def read(self, content, extension):
            assert extension == ".png"
            if content == b"fail":
                raise RuntimeError("no answer")
            return content.decode()

    clear, many = "This page has a text layer that anyone can read, as it is made of words and they are many. " * 2, 25
    page = lambda doc, i, text, ink, picture: (doc, "f.pdf", i, text, ink, picture)
    said = lambda i: f"What stands on page number {i} of the scan".encode()
    rows = [page("a", 0, clear, True, said(0)), page("a", 1, "", True, said(1)), page("a", 2, None, False, said(2)), page("a", 3, "\x01\x02" * 80, True, said(3)), page("a", 4, "short", True, b"empty"), page("a", 5, "", True, b"fail"), page("a", 6, "", True, None)]
    rows += [page("b", i, "", True, said(i)) for i in range(many)] + [page("c", 0, clear, True, said(0))]
    pages = spark.createDataFrame(rows, "doc string, filename string, page int, text string, ink boolean, picture binary").repartition(3)
    got = {r["doc"]: r for r in attachments.read_scans(pages, Eyes()).collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"]["text"] == "\n".join(said(i).decode() for i in (1, 3)) and (got["a"]["scans"], got["a"]["asked"]) == (5, 5)
    assert got["b"]["text"] == "\n".join(said(i).decode() for i in range(20)) and (got["b"]["scans"], got["b"]["asked"]) == (many, 20)
    assert attachments.read_scans(pages.limit(0), Eyes()).count() == 0


def test_cursors_from_last_pages():
    rng = random.Random(4)
    for _ in range(60):
        rows = sorted(({"id": f"{i}", "modified": f"{rng.randrange(30):03}"} for i in range(rng.randrange(90))), key=lambda r: (r["modified"], r["id"]))
        fetch = lambda since, page, rows=rows: [r for r in rows if r["modified"] >= since][(page - 1) * 4 : page * 4]
        start = {"since": "", "seen": []}
        while True:
            end = listing.window(fetch, start, 4, 4)[1]
            assert listing.behind(fetch, start, 4, 4) == end
            if end == start:
                break
            start = end
        assert not rows or start["since"] == rows[-1]["modified"]
    same = [{"id": f"s{i}", "modified": "t"} for i in range(40)]
    with pytest.raises(listing.Stalled):
        listing.behind(lambda s, p: same[(p - 1) * 4 : p * 4], {"since": "t", "seen": []}, 4, 3)


def test_a_long_table_is_served_in_parts(spark, monkeypatch):
    import pyarrow.parquet as pq

    n, read = 300_000, []
    id = F.col("id").cast("string")
    rows = spark.range(n).select(F.md5(id).alias("id"), F.format_string("%07d", F.col("id") % 90_001).alias("modified"), F.sha1(id).alias("x"))
    path = listing.in_order(rows, "served")
    monkeypatch.setattr(pq, "read_table", None)
    one = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda f, i: read.append(f.metadata.row_group(i).num_rows) or one(f, i))
    plain = sorted((r["modified"], r["id"]) for r in rows.select("modified", "id").collect())
    times = [t for t, _ in plain]
    for since in ("", "0000500", "0050000", "0090000", "1"):
        del read[:]
        fetch = listing.from_table(path, 700)
        for page in (1, 2, 7):
            at = bisect_left(times, since) + (page - 1) * 700
            assert [(r["modified"], r["id"]) for r in fetch(since, page)] == plain[at : at + 700]
        assert sum(read) < n / 3
    path = listing.scratch_path(spark, "unordered")
    rows.coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    with pytest.raises(ValueError, match="order"):
        listing.from_table(path)


def test_the_driver_asks_a_listing_for_cursors_and_tasks_for_rows(tmp_path):
    rows = [{"id": f"{i:04}", "modified": f"{i // 3:05}"} for i in range(5000)]
    path = tmp_path / "l.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    reader = listing.ListingSource({"path": str(path), "pagerows": "20", "pages": "10", "windows": "9"}).streamReader(None)
    fetch, got = reader.fetch(), []
    reader.asked = lambda since, page: got.append(x := fetch(since, page)) or x
    start, found = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        tasks = reader.partitions(start, end)
        assert len(tasks) <= 9
        found += [[r[0] for r in reader.read(t)] for t in tasks]
        start = end
    assert [i for task in found for i in task] == [r["id"] for r in rows] and max(map(len, found)) <= 200
    assert sum(map(len, got)) < len(rows) / 3
