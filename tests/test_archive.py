"""The archive's operators: the reference expectations, golden texts, and the registered queries against their SQL."""

import os
import random
import threading
import time
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.functions.exprs import html_title, is_html_file, normal_url
from lumenfold.functions.html_text import extract_text
from lumenfold.functions.urls import archive_path
from lumenfold.operators import consistency, search, stats, tasks, users
from lumenfold.operators.lifecycle import Archive, discover, wait_for_file
from lumenfold.operators.ranks import numbered
from lumenfold.plans import oracles, tables
from lumenfold.schemas import ArchiveError, Cancelled, DocumentMissing, FileMissing, InvalidPath
from lumenfold.sources import archive as archive_source
from lumenfold.sources.archive import html_files, list_files
from lumenfold.sources.store import Store
from lumenfold.sources.zip_files import safe_entry, unzip_backup, zip_backup, zip_entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    with duckdb.connect() as con:
        for table in ("pages", "events", "customer", "documents", "supplier"):
            con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        found = con.execute(__spark_entry__.oracle_sql()[name])
        columns, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_every_titled_page_is_built(spark):
    titled = spark.read.parquet(f"{SF}/pages.parquet").where(html_title("html").isNotNull())
    want = {f"{r['page_id']}.html" for r in titled.select("page_id").collect()}
    assert {r["filename"] for r in __spark_entry__.queries()["rebuild_lenient"](spark, SF).select("filename").collect()} == want


@pytest.mark.parametrize("page, text", [
    ("<title>T</title><p>a<b>c</b>d</p>", "Tadc"), ("<title>T</title><p>&lt;b&gt;x</p>", "Tx"), ("<title>T</title><p>1 &lt; 2</p>", "T1<2"),
    ("<title>T</title><p>a&amp;lt;b</p>", "Ta<b"), ("<title>T</title><p>a \n b\tc</p>", "Tab\tc"), ("<p><b>x<br><p>y</p>", "xy"),
    ("<style>s</style><script>x</script><h1>Hello</h1><p>World</p>", "HelloWorld"), ("", ""),
])
def test_text_by_depth(page, text):
    assert extract_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<b>" + "<div>x" * 20_000, "<x>" * 50_000 + "</y>" * 50_000, "<ul><li>" * 20_000 + "x", "<a " * 100_000])
def test_text_of_deep_pages_takes_linear_time(page):
    began = time.process_time()
    extract_text(page)
    assert time.process_time() - began < 10


def test_titles_names_and_urls(spark):
    titles = ["<TITLE>A</TITLE>", "<title></title>", '<title lang="en">A</title>', "<title>A\nB</title>", "<title>A&amp;B</title>", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, h string")
    assert [r[0] for r in rows.orderBy("k").select(html_title("h")).collect()] == ["A", "", None, None, "A&amp;B", None]
    names = spark.createDataFrame([("a.html",), (".HTM",), ("a.txt",), ("a.html\n",)], "n string")
    assert [r[0] for r in names.select(is_html_file("n")).collect()] == [True, True, False, False]
    urls = spark.createDataFrame([(" https://Example.COM/path?q=1#fragment ",), ("",), ("ftp://example.com",), ("https:///missing-host",)], "u string")
    got = [tuple(r[0]) for r in urls.select(normal_url("u")).collect()]
    assert got[0] == ("https://Example.COM/path?q=1", "example.com", None)
    assert all(u is None and error for u, _, error in got[1:])


URLS = [
    ("https://a b.com/x", "url is malformed"), ("https://h:99999x/", "url is malformed"), ("https://h/%zz", "url is malformed"), ("https://h\\x/", "url is malformed"),
    ("https://h/a b", ("https://h/a%20b", "h")), ("https://h/%41%2fb c", ("https://h/A/b%20c", "h")), ("https://h/%41", ("https://h/%41", "h")), ("http://u:p@H:80/?", ("http://u:p@H:80/?", "h")),
    ("https://[::1]:8/x", ("https://[::1]:8/x", "::1")), ("https://[::1", "url is malformed"), ("https://[::1]x/", "url is malformed"), ("https://[fe80::1%25en0]/", ("https://[fe80::1%25en0]/", "fe80::1%en0")),
    ("https://h%41/", "url is malformed"), ("https://u^@h/", "url is malformed"), ("https://a@b@h/", ("https://a%40b@h/", "h")), ("HTTPS://h?x y", ("https://h?x y", "h")), ("https://h/#%zz", "url is malformed"),
    ("https://:80/", "url host is missing"), ("https:h", "url host is missing"), ("https:/h", "url host is missing"), ("h:80/x", "url scheme is not supported"), ("1h:80", "url is malformed"),
    ("//h/x", "url scheme is not supported"), (":x", "url is malformed"), ("ftp://h/%zz", "url is malformed"), ("mailto:%zz", "url scheme is not supported"), ("https://h/é(x)", ("https://h/%C3%A9%28x%29", "h")),
    ("https://bü.x/", ("https://b%C3%BC.x/", "bü.x")), ("https://h/\x01", "url has control characters"), ("https://h/#\x01", ("https://h/", "h")), ("\u00a0https://h/\u2003", ("https://h/", "h")), (None, "url is empty"),
]


def test_url_grammar(spark):
    table = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(URLS)], "k int, u string").select("k", normal_url("u").alias("x"))
    got = {r["k"]: tuple(r["x"]) for r in table.collect()}
    for k, (url, want) in enumerate(URLS):
        assert got[k] == ((*want, None) if isinstance(want, tuple) else (None, None, want)), url


def test_request_paths():
    assert archive_path("/archive/example.com/saved%20page.html") == ("example.com", "saved page.html")
    for bad in ("/archive/example.com/../secret.html", "", "/other/a.html", "/archive/example.com"):
        with pytest.raises(InvalidPath):
            archive_path(bad)


def test_count_arithmetic(spark):
    frame = lambda rows, name="file_count": spark.createDataFrame(rows, f"source string, {name} long")
    held = stats.replace(frame([("b", 2), ("a", 1)]))
    held = stats.increment(held, frame([("a", 2), ("c", 4), (" ", 9), ("a", 0)], "delta"))
    held = stats.decrement(held, frame([("a", 1), ("b", 5), ("x", 1)], "delta"))
    assert {tuple(r) for r in held.collect()} == {("a", 2), ("c", 4)}
    assert tuple(stats.snapshot(frame([("a", 2), ("bad", -1), ("b", 3)])).first()) == (5, 2)


def test_task_lookups(spark):
    held = spark.createDataFrame(
        [("t1", "u", "success", 1), ("t2", "u", "running", 2), ("t0", "v", "success", 1), ("t9", "v", "failed", 1)],
        "id string, url string, status string, at long",
    ).select("id", "url", "status", F.timestamp_seconds("at").alias("created_at"))
    assert {(r["url"], r["id"]) for r in tasks.latest(held).collect()} == {("u", "t2"), ("v", "t0")}
    assert [r["id"] for r in tasks.active(held).collect()] == ["t2"]
    assert {tuple(r) for r in tasks.decide(held).collect()} == {("u", "reuse_active"), ("v", "reuse_success")}
    assert [tuple(r) for r in tasks.recovery(held).collect()] == [("t2", "running", 1)]


def test_search_ranks_and_pages(spark):
    docs = spark.createDataFrame(
        [("1", "quick brown fox", "a", "d", "x"), ("2", "quick", "b", "d", "a brown one"), ("3", "quack", "c", "d", ""), ("4", "brownish", "d", "d", None)],
        "id string, title string, filename string, domain string, content string",
    )
    hits = search.search(docs, "quick brown").collect()
    assert [r["id"] for r in hits] == ["1", "2", "3"]
    assert hits[1]["content"] == f"a {search.OPEN_TAG}brown{search.CLOSE_TAG} one"
    assert tuple(search.totals(search.ranked(docs, "quick")).first()) == (3, 1)
    assert search.search(docs, "quick", 2).count() == 0
    for query, page in (("", 1), ("quick", 0)):
        with pytest.raises(ArchiveError):
            search.search(docs, query, page)


def test_stored_index_ranks_like_the_documents(spark, tmp_path):
    docs = spark.createDataFrame(
        [(str(k), f"quick brown fox {k}", "a", "d", "x brown" * k) for k in range(30)] + [("a", None, None, None, None), ("b", "", "", "", ""), ("c", "漢字 quack", "f", "d", "é")],
        "id string, title string, filename string, domain string, content string",
    )
    index = search.Index(Store(spark, str(tmp_path)))
    index.build(docs)
    for query in ("quick brown", "brown fix", "漢字", "quack", "nothing"):
        want = {tuple(r) for r in search.ranked(docs, query).collect()}
        # An index adds its own key (segment, doc) to these columns.
        assert {tuple(r) for r in search.ranked(index, query).select("id", "words", "typos", "gaps", "field", "exact").collect()} == want
    assert search.padded(search.search(docs, "quack", index=index)).count() == search.HITS_PER_PAGE


def test_restore_candidates(spark):
    entries = [("backup/x.dump", True), ("a.DUMP", True), ("b/c/database.SQL", True), ("a.sql", True), ("z/Archive", False), ("a/b/archive", False), ("archive", True)]
    row = discover(spark.createDataFrame(entries, "path string, is_file boolean")).first()
    assert tuple(row) == ("a.DUMP", "b/c/database.SQL", "z/Archive")
    assert tuple(discover(spark.createDataFrame([], "path string, is_file boolean")).first()) == (None, None, None)
    names = spark.createDataFrame([("a/b",), ("../a",), ("/a",), ("a\\..\\b",), (".",), ("a..b",)], "path string")
    assert [r[0] for r in names.select(safe_entry("path")).collect()] == [True, False, False, False, False, True]


def test_waiting(tmp_path):
    put(tmp_path, "a/p.html")
    assert wait_for_file(str(tmp_path / "a/p.html"), 0)
    with pytest.raises(FileMissing):
        wait_for_file(str(tmp_path / "none"), 0.1, 0.02)
    cancel = threading.Event()
    threading.Timer(0.2, cancel.set).start()
    began = time.monotonic()
    with pytest.raises(Cancelled):
        wait_for_file(str(tmp_path / "none"), 60, 30, cancel)
    assert time.monotonic() - began < 10
    with pytest.raises(Cancelled):  # even if the file is there
        wait_for_file(str(tmp_path / "a/p.html"), 0, cancel=cancel)


def test_places_in_an_order(spark):
    # A third of the rows share the first value, as an hour with a burst of tasks does.
    rows = [(None if k % 10 == 0 else 7 if k % 3 == 0 else k % 50, f"n{k:04d}", k) for k in range(3000)]
    table = spark.createDataFrame(rows, "a int, b string, `c.d` int").repartition(5)
    got = {r["b"]: r["place"] for r in numbered(table, F.desc("a"), "b", name="place").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r[1]: k + 1 for k, r in enumerate(want)}
    ascending = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    placed = numbered(table, "a", "b").select("b", "pos", "`c.d`").collect()
    assert {r[0]: r[1] for r in placed} == {r[1]: k + 1 for k, r in enumerate(ascending)}
    alike = numbered(table.select(F.lit(1).alias("a")), "a").select("pos").collect()
    assert sorted(r[0] for r in alike) == list(range(1, 3001))
    assert numbered(table.limit(0), "a").count() == 0 and numbered(table, "a").columns == ["a", "b", "c.d", "pos"]


def test_a_burst_of_rows_is_ordered_by_several_tasks(spark):
    burst = spark.range(40_000).select(F.lit(0).alias("created_at"), F.col("id").cast("string").alias("id"), F.lit("pending").alias("status"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = numbered(burst, "created_at", "id")
        files = dealt.inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) >= 8
    assert dealt.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (1, 40_000, 40_000)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2 and "row_number" not in plan


def test_zip_files(spark, tmp_path):
    want = {f"backup/archive/d{k % 9}.example/{k} é.html": (f"<title>{k}</title>" + "x" * (k * k)).encode() for k in range(300)}
    want |= {"backup/big": os.urandom(3 << 20), "backup/empty": b""}
    for name, content in want.items():
        os.makedirs(tmp_path / "in" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    os.symlink(tmp_path / "in/backup/big", tmp_path / "in/backup/link")
    ours, theirs = str(tmp_path / "ours.zip"), str(tmp_path / "theirs.zip")
    zip_backup(spark, str(tmp_path / "in"), ours)
    with zipfile.ZipFile(ours) as held:
        assert held.testzip() is None and {n: held.read(n) for n in held.namelist()} == want
    with zipfile.ZipFile(theirs, "w") as out:
        for k, (name, content) in enumerate(want.items()):
            out.writestr(name, content, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        out.writestr("folder/", "")
    for source in (ours, theirs):
        assert unzip_backup(spark, source, f"{source}.out").count() == len(want) == zip_entries(spark, source).count()
        found = {os.path.relpath(f"{at}/{n}", f"{source}.out"): open(f"{at}/{n}", "rb").read() for at, _, names in os.walk(f"{source}.out") for n in names}
        assert found == want
    assert not [n for n in os.listdir(tmp_path) if "parts" in n or "tmp" in n]
    for bad in ("../up.html", "/abs", "a\\..\\..\\b"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as out:
            out.writestr("good", "x"), out.writestr(bad, "x")
        with pytest.raises(InvalidPath):
            unzip_backup(spark, str(tmp_path / "bad.zip"), str(tmp_path / "bad"))
        assert not os.path.exists(tmp_path / "bad")
    os.makedirs(tmp_path / "nothing")
    zip_backup(spark, str(tmp_path / "nothing"), str(tmp_path / "none.zip"))
    assert unzip_backup(spark, str(tmp_path / "none.zip"), str(tmp_path / "none")).count() == 0


def test_recheck_reads_changed_pages_only(spark, tmp_path):
    from lumenfold.operators.manifest import recheck

    root, draw = str(tmp_path / "pages"), random.Random(4)
    for k in range(30):
        put(root, f"d{k % 4}.example/{k}.html")
    archive = Archive(spark, root, Store(spark, str(tmp_path / "store")))
    archive.rebuild()
    archive.refresh_counts()
    assert recheck(archive)[1] == 30 and recheck(archive)[1] == 0
    for _ in range(3):
        names = [os.path.join(at, n) for at, _, files in os.walk(root) for n in sorted(files)]
        changed, gone = draw.sample(names, 3), draw.sample(names, 2)
        for path in changed:
            with open(path, "w") as out:
                out.write(draw.choice(["<p>no title</p>", "<title>new</title>", ""]) + "x" * draw.randint(1, 9))
        for path in gone:
            os.remove(path)
        put(root, f"e.example/{draw.random()}.html")
        issues, read = recheck(archive)
        assert read == len(set(changed) - set(gone)) + 1
        assert sorted(map(repr, issues.collect())) == sorted(map(repr, archive.check().collect()))


def test_polling():
    answers = iter([("running", "", "", ""), ("failed", "", "7", "boom")])
    assert tasks.poll(lambda url: next(answers), lambda url: next(answers), "u", pause=0) == ("", "7", "boom")
    assert tasks.poll(lambda url: ("success", "f", "1", ""), None, "u") == ("f", "1", "")
    assert tasks.poll(lambda url: ("running", "", "1", ""), None, "u", seconds=0)[2] == "timed out"


def test_users(spark):
    held = spark.createDataFrame([(1, "admin")], "id long, username string").withColumns({c: F.current_timestamp() for c in ("created_at", "updated_at")})
    held = users.create(held, spark.createDataFrame([("bob",), ("admin",), ("bob",)], "username string"))
    assert [r["username"] for r in users.page(held, 1, 10).collect()] == ["admin", "bob"]
    assert users.page(held, 2, 1).select("username", "total").collect() == [("bob", 2)]


def put(root, path, content="<title>T</title><p>x</p>"):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w") as out:
        out.write(content)


def test_scan(spark, tmp_path):
    names = ["example.com/one.html", "example.com/nested/two.HTML", "example.com/legacy.htm", "example.com/ignored.txt", "news.example/article.html",
             "Temporary/upload.html", "root.html", "_under.example/p.html", ".dot/p.html"]
    for name in names:
        put(tmp_path, name)
    found = stats.count_by_source(html_files(list_files(spark, str(tmp_path))))
    assert {tuple(r) for r in found.collect()} == {("example.com", 3), ("news.example", 1), ("_under.example", 1), (".dot", 1)}
    assert list_files(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(ArchiveError):
        list_files(spark, " ")


def test_archive_lifecycle(spark, tmp_path):
    root = str(tmp_path / "pages")
    put(root, "example.com/page.html")
    put(root, "broken.example/bad.html", "<p>no title</p>")
    archive = Archive(spark, root, Store(spark, str(tmp_path / "store")))
    lost = spark.createDataFrame([("o", "t", "lost.html", "old.example", "")], "id string, title string, filename string, domain string, content string")
    archive.store.write("documents", lost)
    assert {r["code"] for r in archive.check().collect()} == {"doc_missing", "doc_orphan", "html_unparseable", "stat_source_mismatch", "stat_total_mismatch"}
    left = archive.repair()
    assert {(r["code"], r["recoverable"]) for r in left.collect()} == {("doc_orphan", False), ("html_unparseable", False)}
    archive.add_file("example.com", "new.html", "<title>N</title>n")
    assert archive.docs().count() == 2 and archive.counts().where("source = 'example.com'").first()["file_count"] == 2
    with pytest.raises(ArchiveError):
        archive.rebuild(strict=True)
    assert len(archive.delete("/archive/example.com/new.html")) == 1
    assert not os.path.exists(f"{root}/example.com/new.html")
    with pytest.raises(FileMissing):
        archive.delete("/archive/example.com/new.html")
    put(root, "example.com/loose.html")
    with pytest.raises(DocumentMissing):
        archive.delete("/archive/example.com/loose.html")
    os.remove(f"{root}/broken.example/bad.html")
    archive.rebuild()
    archive.backup(str(tmp_path / "b"))
    archive.delete("/archive/example.com/page.html")
    archive.restore(str(tmp_path / "b"))
    assert archive.docs().count() == 2 and archive.check().count() == 0


def test_upload_stream(spark, tmp_path):
    from lumenfold.streaming.uploads import arriving, compact, ingest, stored_counts, stored_documents

    put(tmp_path, "in/a.example/1.html")
    put(tmp_path, "in/b.example/2.html")
    store = Store(spark, str(tmp_path / "store"))
    ingest(arriving(spark, str(tmp_path / "in")), store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in stored_counts(store).collect()} == {("a.example", 1), ("b.example", 1)}
    put(tmp_path, "in/a.example/3.html", "<title>new</title>z")
    put(tmp_path, "in/b.example/2b.html")
    ingest(arriving(spark, str(tmp_path / "in")), store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for name in ("1", ".1.crc"):  # as if the driver had been lost before the second batch was noted as done
        os.remove(tmp_path / "check/commits" / name)
    ingest(arriving(spark, str(tmp_path / "in")), store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        assert {tuple(r) for r in stored_counts(store).collect()} == {("a.example", 2), ("b.example", 2)}
        assert stored_documents(store).count() == 4
        compact(store)


def test_upload_stream_agrees_with_scan(spark, tmp_path):
    from lumenfold.streaming.uploads import arriving, compact, ingest, stored_counts, stored_documents

    for name in ("a.example/dir/p.html", "b.example/dir/p.html", "b.example/x y%20.html", "Temporary/u.html", "loose.html"):
        put(tmp_path, f"in/{name}")
    root, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    ingest(arriving(spark, root), store, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in html_files(list_files(spark, root)).select("domain", "filename").collect()}
    assert len(want) == 3 and {tuple(r) for r in stored_documents(store).select("domain", "filename").collect()} == want
    assert {tuple(r) for r in stored_counts(store).collect()} == {("a.example", 1), ("b.example", 2)}


def test_repair_scans_the_folder_once(spark, tmp_path, monkeypatch):
    pages = {"a.example/1.html": "<title>A</title>x", "a.example/2.html": "no title"}
    for rel, html in pages.items():
        (tmp_path / "tree" / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / rel).write_text(html)
    archive, scans, scan = Archive(spark, str(tmp_path / "tree"), Store(spark, str(tmp_path / "store"))), [], Archive.scan
    monkeypatch.setattr(Archive, "scan", lambda self: scans.append(1) or scan(self))
    assert [(r["code"], r["filename"]) for r in archive.repair().collect()] == [("html_unparseable", "2.html")] and len(scans) == 1
    assert [r["filename"] for r in archive.docs().collect()] == ["1.html"]


def test_issues_of_a_repair_need_no_text(spark):
    left = consistency.repair(tables.files(spark, SF), tables.index(spark, SF), tables.counted(spark, SF))[2]
    assert "MapInArrow" not in left._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_and_written_some_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_source, "READ", 10)
    held = spark.createDataFrame([(f"d/{k}.html", "é" * k if k else None) for k in range(70)], "rel string, html string")
    assert archive_source.write_pages(held, str(tmp_path)).count() == 70
    read = archive_source.read_pages(html_files(list_files(spark, str(tmp_path))))
    assert {r["filename"]: r["html"] for r in read.collect()} == {f"{k}.html": "é" * k for k in range(70)}
