"""Stored truth of documents and counts, the task chain, the stream of task states, and the page data source."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import search, tasks
from lumenfold.operators.lifecycle import Archive
from lumenfold.operators.segments import Index
from lumenfold.schemas import InvalidPath
from lumenfold.sources import page_source
from lumenfold.sources.store import Store, stored_counts, stored_documents
from lumenfold.streaming import task_stream

PAGE = "<title>T</title><p>some words</p>"


def put(root, path, content=PAGE):
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w") as out:
        out.write(content)


def counts(archive):
    return {r["source"]: r["file_count"] for r in archive.counts().collect()}


def test_archive_and_stream_share_one_truth(spark, tmp_path):
    from lumenfold.streaming.uploads import arriving, compact, ingest

    root, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    index = Index(store)
    archive = Archive(spark, root, store, index)
    stream = lambda: ingest(arriving(spark, root), store, str(tmp_path / "check"), index).trigger(availableNow=True).start().awaitTermination()
    for name in ("a.example/1", "a.example/2", "b.example/3"):
        put(root, f"{name}.html")
    stream()
    assert archive.docs().count() == 3 and counts(archive) == {"a.example": 2, "b.example": 1} and archive.check().count() == 0
    assert search.ranked(index, "words").count() == 0 and search.ranked(index, "somewords").count() == 3  # spaces are erased
    archive.rebuild()
    archive.refresh_counts()
    assert archive.docs().count() == 3 and counts(archive) == {"a.example": 2, "b.example": 1}
    assert archive.delete("/archive/a.example/2.html") and archive.delete("/archive/b.example/3.html")
    assert archive.docs().count() == stored_documents(store).count() == 1 and counts(archive) == {"a.example": 1} == {r[0]: r[1] for r in stored_counts(store).collect()}
    assert archive.check().count() == 0 and search.ranked(index, "somewords").count() == 1
    for name in ("1", ".1.crc", "0", ".0.crc"):  # the stream's last batch comes again, after a whole write took it in
        if os.path.exists(tmp_path / "check/commits" / name):
            os.remove(tmp_path / "check/commits" / name)
    put(root, "c.example/4.html")
    stream()
    assert archive.docs().count() == 2 and counts(archive) == {"a.example": 1, "c.example": 1} and archive.check().count() == 0
    archive.add_file("c.example", "5.html", "<title>N</title>other")
    before = set(store.parts("documents"))
    archive.add(spark.createDataFrame([("d.example", f"{k}.html", PAGE) for k in range(3)], "domain string, filename string, html string"))
    assert len(set(store.parts("documents")) - before) == 1 and counts(archive)["d.example"] == 3 and archive.check().count() == 0
    compact(store)
    assert len(store.parts("documents")) == 1 and archive.docs().count() == 6 and archive.check().count() == 0
    with pytest.raises(InvalidPath):
        archive.add_file("x.example", "../../up.html", PAGE)


SEEN = "seen"


def counting(folder):
    def fetch(url):
        with open(f"{folder}/{SEEN}", "a") as out:
            out.write(url + "\n")
        return ("" if "none" in url else url[8:].replace("/", "") + ".html", "e-" + url[8:9], "boom" if "bad" in url else "")

    return fetch


TASKS = "id string, url string, domain string, status string, file_name string, error string, external_task_id string, created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"


def pending(spark, urls):
    now = datetime.datetime(2030, 1, 1)
    return spark.createDataFrame([(str(k), u, u[8:].split("/")[0], "pending" if k % 2 else "running", "", "", "", now, now, None, None) for k, u in enumerate(urls)], TASKS)


def test_each_url_is_fetched_once(spark, tmp_path):
    done = tasks.run(pending(spark, [f"https://h{k}/" for k in range(10)]), counting(tmp_path))
    assert done.count() == 10 and done.where("status = 'success'").count() == 10
    assert sorted(open(tmp_path / SEEN).read().split()) == sorted(f"https://h{k}/" for k in range(10))


def test_tasks_go_through_to_the_index(spark, tmp_path):
    root, store = str(tmp_path / "pages"), Store(spark, str(tmp_path / "store"))
    archive = Archive(spark, root, store, Index(store))
    put(root, "a.html"), put(root, "b.html", "<p>untitled</p>"), put(root, "c.html")
    urls = ["https://a", "https://b", "https://c", "https://missing", "https://bad", "https://none"]
    done = tasks.process(pending(spark, urls), counting(tmp_path), archive, 0)
    found = {r["url"][8:]: (r["status"], r["error"], r["file_name"]) for r in done.collect()}
    assert found["a"] == found["c"][:2] + ("a.html",) == ("success", "", "a.html") and found["b"] == ("failed", "no title found", "b.html")
    assert found["bad"][:2] == ("failed", "boom") and all(found[k][0] == "failed" and found[k][1].startswith("no file") for k in ("missing", "none"))
    assert sorted(open(tmp_path / SEEN).read().split()) == sorted(urls)
    assert os.path.exists(f"{root}/a/a.html") and not os.path.exists(f"{root}/a.html") and os.path.exists(f"{root}/b.html")
    assert counts(archive) == {"a": 1, "c": 1} and search.ranked(archive.index, "somewords").count() == 2


def test_stream_of_task_states(spark, tmp_path):
    events, start = str(tmp_path / "events"), datetime.datetime(2030, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    batch = [0]

    def send(*rows):
        batch[0] += 1
        table = spark.createDataFrame([(u, kind, at(s), i, status, name, "", error) for u, kind, s, i, status, name, error in rows], task_stream.EVENTS)
        table.coalesce(1).write.parquet(f"{events}/in-{batch[0]}")
        stream = task_stream.changes(task_stream.reading(spark, events))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return {(r["url"], r["action"], int((r["at"] - start).total_seconds())) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    submit = lambda u, s: (u, "submit", s, "", "", "", "")
    one, two = (task_stream.task_id(u, int(start.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)) for u in ("u1", "u2"))
    got = send(submit("u1", 0), submit("u1", 0), submit("u1", 5), submit("u2", 0), (None, "submit", 0, "", "", "", ""))
    assert got == {("u1", "fetch", 0), ("u1", "reuse_active", 5), ("u2", "fetch", 0)}
    got = send(("u1", "answer", 10, one, "success", "f.html", ""), ("u1", "answer", 10, one, "success", "f.html", ""), ("u2", "answer", 10, "other", "success", "x", ""), submit("u1", 0))
    assert {x for x in got if x[2] == 10} == {("u1", "wait", 10)}
    got = send(("u1", "file", 12, one, "", "", ""), ("u1", "indexed", 13, one, "", "", ""), ("u2", "file", 12, two, "", "", ""), submit("u1", 14))
    assert {x for x in got if x[2] > 10} == {("u1", "index", 12), ("u1", "success", 13), ("u1", "reuse_success", 14)}
    got = send(submit("u3", 500))  # time goes on: the second task's limit is over
    got = send(submit("u3", 501))
    assert ("u2", "failed", 120) in got
    got = send(("u2", "answer", 502, two, "success", "late.html", ""), submit("u2", 503))  # a late answer, and a new task
    rows = [r for r in spark.read.parquet(str(tmp_path / "out")).where("url = 'u2'").collect()]
    assert [r["action"] for r in sorted(rows, key=lambda r: r["at"])] == ["fetch", "failed", "fetch"] and len({r["task_id"] for r in rows}) == 2
    assert next(r for r in rows if r["action"] == "failed")["error"] == "timed out"


def test_stream_fetches_each_url_once(spark, tmp_path):
    events, check = str(tmp_path / "events"), str(tmp_path / "check")
    base = datetime.datetime(2030, 1, 1)
    rows = [(f"https://h{k % 4}/", "submit", base + datetime.timedelta(seconds=k), "", "", "", "", "") for k in range(12)]
    spark.createDataFrame(rows, task_stream.EVENTS).write.parquet(f"{events}/submitted")
    go = lambda: task_stream.answering(task_stream.changes(task_stream.reading(spark, events)), counting(tmp_path), events, check, F.lit(base + datetime.timedelta(seconds=30))).trigger(availableNow=True).start().awaitTermination()
    go()
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the driver had been lost before the batch was noted as done
        os.remove(f"{check}/commits/{name}")
    go()
    go()
    assert sorted(open(tmp_path / SEEN).read().split()) == [f"https://h{k}/" for k in range(4)]
    answers = spark.read.option("recursiveFileLookup", "true").schema(task_stream.EVENTS).parquet(f"{events}/answers")
    assert answers.count() == 4 and answers.where("status = 'success' and file_name <> ''").count() == 4


@pytest.fixture()
def tree(spark, tmp_path):
    page_source.register(spark)
    root, draw = str(tmp_path / "tree"), random.Random(2)
    want = set()
    for k in range(60):
        rel = f"d{k % 7}.example/{draw.choice(['', 'deep/er/'])}{k}.{draw.choice(['html', 'HTM', 'txt'])}"
        put(root, rel, f"page {k} é")
        if not rel.endswith("txt"):
            want.add((rel.split("/")[0], rel.split("/", 1)[1], f"page {k} é"))
    put(root, "Temporary/x.html"), put(root, "loose.html")
    return root, want


def test_page_source_reads_and_takes_filters(spark, tree):
    root, want = tree
    table = spark.read.format("archive_pages").load(root)
    assert {tuple(r) for r in table.collect()} == want
    one = table.where("domain = 'd3.example' and filename like '%.html'")
    assert {tuple(r) for r in one.collect()} == {w for w in want if w[0] == "d3.example" and w[1].endswith(".html")}
    assert {tuple(r) for r in table.where("domain in ('d1.example', 'd2.example') and domain <> 'd1.example'").collect()} == {w for w in want if w[0] == "d2.example"}
    reader = page_source.PageReader(root)
    left = list(reader.pushFilters([page_source.EqualTo(("domain",), "d3.example"), page_source.EqualTo(("filename",), "x")]))
    assert len(left) == 1 and [p.names for p in reader.partitions()] == [["d3.example"]]
    plan = table.where("domain = 'd3.example'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan archive_pages" in plan  # all of it is the source's
    assert table.rdd.getNumPartitions() == 7


def test_page_source_writes_and_aborts(spark, tree, tmp_path):
    root, want = tree
    target = str(tmp_path / "copy")
    os.makedirs(target)
    spark.read.format("archive_pages").load(root).write.format("archive_pages").mode("append").save(target)
    assert {tuple(r) for r in spark.read.format("archive_pages").load(target).collect()} == want and not [n for n in os.listdir(target) if n.startswith(".")]
    bad = spark.createDataFrame([("a.example", f"{k}.html" if k else "../up.html", "x") for k in range(8)], "domain string, filename string, html string")
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("archive_pages").mode("append").save(target)
    assert {tuple(r) for r in spark.read.format("archive_pages").load(target).collect()} == want and not [n for n in os.listdir(target) if n.startswith(".")]


def test_page_source_streams_new_files_once(spark, tree, tmp_path):
    root, want = tree
    out = str(tmp_path / "out")

    def go():
        stream = spark.readStream.format("archive_pages").load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert go() == sorted(want)
    put(root, "d0.example/new.html", "later")
    assert go() == go() == sorted(want | {("d0.example", "new.html", "later")})
