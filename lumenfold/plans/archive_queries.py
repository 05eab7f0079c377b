"""Registered queries over the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.exprs import erase_space, normal_url
from lumenfold.operators import consistency, lifecycle, search, stats, tasks, users
from lumenfold.operators.issues import merge
from lumenfold.operators.ranks import numbered
from lumenfold.plans import oracles, tables
from lumenfold.session import scratch_path
from lumenfold.sources.archive import documents, with_text
from lumenfold.sources.store import Store


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.titled(spark, sf_dir)


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", normal_url("url").alias("u")).select("page_id", "u.url", "u.domain")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_source(tables.pages(spark, sf_dir))


def stats_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = source_stats(spark, sf_dir).withColumn("file_count", F.col("file_count") - 3)
    return stats.snapshot(lowered)


def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shares(source_stats(spark, sf_dir))


def _delta(counts: DataFrame) -> DataFrame:
    return counts.withColumnRenamed("file_count", "delta")


def stats_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.pages(spark, sf_dir)
    old, new = (stats.count_by_source(held.where(F.col("page_id") % 2 == k)) for k in (0, 1))
    return stats.increment(old, _delta(new))


def stats_decrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.pages(spark, sf_dir)
    return stats.decrement(stats.count_by_source(held), _delta(stats.count_by_source(held.where("page_id % 3 = 0"))))


def task_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.latest(tables.tasks(spark, sf_dir)).select("id", "url", "status")


def task_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.active(tables.tasks(spark, sf_dir)).select("id", "url", "status")


def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.recovery(tables.tasks(spark, sf_dir))


def task_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.decide(tables.tasks(spark, sf_dir))


def task_http_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.response(tables.tasks(spark, sf_dir))


def users_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return users.page(held, 3, 10)


def consistency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.compare_files(tables.files(spark, sf_dir), tables.index(spark, sf_dir))
    return found.select("domain", "filename", "code")


def consistency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = stats.count_by_source(tables.files(spark, sf_dir))
    return consistency.compare_stats(disk, tables.counted(spark, sf_dir)).select("source", "disk_count", "db_count", "code")


def consistency_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consistency.compare_files(tables.files(spark, sf_dir), tables.index(spark, sf_dir))
    return merge(found, found.where("severity = 'error'")).select("severity", "store", "code", "domain", "filename")


def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, index = tables.files(spark, sf_dir), tables.index(spark, sf_dir)
    return consistency.report(consistency.compare_files(held, index), held, index)


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without the page 11.html, whatever its domain."""
    index = tables.index(spark, sf_dir)
    return lifecycle.without(index, index.where("filename = '11.html'")).select("id")


def text_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    erased = tables.table(spark, sf_dir, "documents").select("doc_id", erase_space("text").alias("x"))
    return erased.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("h"))


def search_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.word_hits(search.postings(tables.titled(spark, sf_dir), ("title",), "page_id"), "the", "th", "page_id")
    ranked = numbered(hits, F.desc("words"), F.desc("tf"), "page_id", name="rnk")
    total = F.broadcast(ranked.agg(F.count("*").alias("total_hits")))  # one row
    return ranked.join(total, F.lit(True)).select("page_id", "words", "tf", "rnk", "total_hits")


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as search documents: the lang as title."""
    held = tables.table(spark, sf_dir, "documents")
    return held.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.lit("").alias("filename"), F.col("source").alias("domain"), F.col("text").alias("content"))


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of the library, built once for all queries of a session: half at first, the rest in two additions."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        index, held = search.Index(Store(spark, scratch_path(spark, "search"))), _library(spark, sf_dir)
        number = F.col("id").cast("long") % 4
        index.build(held.where(number < 2))
        index.add(held.where(number == 2))
        index.add(held.where((number == 3) | number.isNull()))
        _indexes[at] = index
    return _indexes[at]


def _longs(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumns({n: F.col(n).cast("long") for n in names})


RANKS = ("words", "typos", "gaps", "field", "exact")


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the pages by their titles, the postings made on the way."""
    docs = tables.titled(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("id"), "title", *[F.lit("").alias(c) for c in ("filename", "domain", "content")]
    )
    return _longs(search.ranked(docs, "the there"), *RANKS)


def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the documents from a stored index."""
    return _longs(search.ranked(_index(spark, sf_dir), "there the"), *RANKS).select("id", *RANKS)


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a stored index."""
    return _index(spark, sf_dir).counted()


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms of the titles match which words of a query, and how."""
    places = search.postings(tables.titled(spark, sf_dir), ("title",), "page_id")
    return _longs(search.matching_terms(places, ["there", "tionthere", "th"]), "no", "typos", "exact")


def search_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search over the documents: cropped and highlighted."""
    return search.search(_library(spark, sf_dir), "there the", 2, _index(spark, sf_dir)).drop("spans")


def search_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of a query are in the stored content of the second page's hits."""
    found = search.search(_library(spark, sf_dir), "there the", 2, _index(spark, sf_dir))
    return found.select("id", F.explode("spans").alias("s")).select("id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("no", "start", "length")])


def search_near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms of the documents match the words of a query, typos by equal variants."""
    return _longs(_index(spark, sf_dir).matches(["there", "tionthere", "th", "ingand"]), "no", "typos", "exact")


def search_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from an index that was built, added to in eight parts, replaced in part, deleted from and merged."""
    index, held = search.Index(Store(spark, scratch_path(spark, "upkeep"))), _library(spark, sf_dir)
    number = F.col("id").cast("long")
    index.build(held.where(number % 3 == 0).withColumn("content", F.lit("there was other text before")))
    for k in range(8):
        index.add(held.where((number % 8 == k) & (number % 7 > 0)))
    index.remove(held.where(number % 5 == 0).select("id"))
    index.merge()
    return _longs(search.ranked(index, "there the"), *RANKS).select("id", *RANKS)


def search_library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(search.ranked(_index(spark, sf_dir), "there the"))


def search_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with fewer hits than places, of which those without content are hidden first."""
    hits = search.shown(search.search(_library(spark, sf_dir), "fr")).where("rnk <= 4")
    return search.padded(hits.select("id", "title", "domain", "rnk"))


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.as_json(search.search(_library(spark, sf_dir), "fr").select("id", "title", "domain", "rnk"))


def search_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = search.postings(tables.titled(spark, sf_dir), ("title",), "page_id")
    return search.typo_matches(places, "there", 1, "page_id").select("page_id", F.col("term").alias("t"))


def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.titled(spark, sf_dir).select("page_id", search.highlight("title", "(?i)the", "<em>", "</em>").alias("h"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, as length and digest."""
    read = with_text(tables.table(spark, sf_dir, "pages").select("page_id", "html"), "html", "x")
    return read.select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("h"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(tables.pages(spark, sf_dir))[0]


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a two-word search over documents built from the pages."""
    return search.search(_built(spark, sf_dir), "the market").drop("spans")


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(search.ranked(_built(spark, sf_dir), "the market"))


def search_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts and matches of all documents for a query, their content without any white space and half in another script."""
    glued = F.replace(F.replace("text", F.lit("the "), F.lit("北京")), F.lit(" "), F.lit("京"))
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), glued.alias("content"))
    cut = search.cropped(docs, ["北京", "there"])
    total = lambda name: F.coalesce(F.aggregate(F.transform("spans", lambda s: s[name].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return cut.select("id", F.length("excerpt").cast("long").alias("n"), F.md5("excerpt").alias("h"), F.size("spans").cast("long").alias("matches"), total("start").alias("starts"), total("length").alias("lengths"))


def search_json_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as one JSON string, padded to ten results."""
    hits = search.search(_library(spark, sf_dir), "fr", index=_index(spark, sf_dir)).where("rnk <= 4")
    return search.json_page(hits.withColumn("content", F.concat(F.lit("<&>\"\\"), "id")))


#: The time at which the task queries change tasks.
NOW = "2030-01-01 00:00:00"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks with all their columns."""
    held = tables.tasks(spark, sf_dir)
    empty = lambda name: F.lit("").alias(name)
    began = F.when(F.col("status") == "running", F.col("created_at"))
    return held.select(
        F.col("id").cast("string").alias("id"), "url", F.regexp_extract("url", "//([^/]+)", 1).alias("domain"), "status", empty("file_name"), empty("error"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_task_id"), "created_at", F.col("created_at").alias("updated_at"),
        began.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def task_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.by_id(_tasks(spark, sf_dir), "17").select("id", "url", "domain", "status", "created_at")


def task_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.by_status(_tasks(spark, sf_dir), "pending", "failed").select("id", "status", "created_at")


def task_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.start(_tasks(spark, sf_dir), _now()).select("id", "status", "error", "updated_at", "started_at", "finished_at")


def task_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks after the active ones were closed, every third with an error and without a file."""
    held = _tasks(spark, sf_dir)
    failed = F.col("id").cast("long") % 3 == 0
    outcome = held.where(F.col("status").isin("pending", "running")).select(
        "id", F.when(failed, "").otherwise(F.concat(F.lit("f"), "id")).alias("file_name"), F.lit("").alias("external_task_id"), F.when(failed, "boom").otherwise("").alias("error")
    )
    done = tasks.finish(held, outcome, _now())
    return tasks.save(held, done).select("id", "status", "file_name", "error", "external_task_id", "updated_at", "finished_at")


def _asked(url: str) -> tuple[str, str, str, str]:
    return ("success" if url < "https://u5" else "failed", f"{url[8:-1]}.html", "e", "")


def _created(url: str) -> tuple[str, str, str, str]:
    return "running", "", "", ""


def _fetched(url: str) -> tuple[str, str, str]:
    return tasks.poll(_created, _asked, url, pause=0.0)


def task_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks after the active ones were fetched by polling a service (here a function of the url)."""
    return tasks.run(_tasks(spark, sf_dir), _fetched).select("id", "status", "file_name", "error", "external_task_id")


def task_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that submitting all urls of the pages, and those of all users, adds."""
    urls = tables.table(spark, sf_dir, "pages").select("url").union(tables.tasks(spark, sf_dir).select("url"))
    held = _tasks(spark, sf_dir)
    return tasks.submit(held, urls, _now()).where(F.col("created_at") == _now()).select("url", "domain", "status")


def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of several kinds, most of them refused."""
    kind, url = F.col("page_id") % 7, F.col("url")
    raw = (
        F.when(kind == 0, F.concat(F.lit(" \t"), url, F.lit("\n"))).when(kind == 1, F.concat(F.lit("ftp:"), url)).when(kind == 2, "")
        .when(kind == 3, F.concat(F.lit("https:///"), F.col("page_id").cast("string"))).when(kind == 4, F.regexp_replace(url, "^http", "HTTP"))
        .when(kind == 5, F.concat(url, F.lit("\u0001"))).otherwise(F.concat(url, F.lit("#x")))
    )
    return tables.table(spark, sf_dir, "pages").select("page_id", normal_url(raw).alias("u")).select("page_id", "u.*")


def url_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls with something else in their user, host, port, path, query or fragment."""
    kind, number = F.col("page_id") % 16, F.col("page_id").cast("string")
    host, tail = tables.url_domain("url"), F.regexp_extract("url", "^https?://[^/?#]*([^#]*)", 1)
    made = lambda before, after: F.concat(F.lit("HTTPS://"), F.lit(before), host, F.lit(after))
    forms = [
        made("", " x"), made("", ":9x"), made("", "/%zz"), made("", "\\"), F.concat(made("", "/a b/é/"), number), made("ann:p%40ss@", ":8080"), made("a b@", "/"), made("", ":"),
        F.concat(F.lit("http://[::1]:80/"), host), F.concat(F.lit("http://[::1/"), host), made("bü.", "/(x)!"), made("", "/%41 %2f?q=é#ü"), made("", "/x?a b#%z"), made("%41", "/"),
        F.concat(F.lit("//"), host), F.concat(F.lit("https:"), host),
    ]
    raw = forms[0]
    for k, form in enumerate(forms[1:], 1):
        raw = F.when(kind == k, form).otherwise(raw)
    return tables.table(spark, sf_dir, "pages").select("page_id", normal_url(F.when(tail.isNotNull(), raw)).alias("u")).select("page_id", "u.*")


def stats_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.snapshot_items(source_stats(spark, sf_dir).withColumn("file_count", F.col("file_count") - 3))


def stats_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored counts after a whole new table took their place."""
    store = Store(spark, scratch_path(spark, "stats"))
    store.write("stats", tables.counted(spark, sf_dir))
    store.write("stats", stats.replace(stats.count_by_source(tables.files(spark, sf_dir))))
    return store.read("stats")


def users_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return users.by_name(held, "Customer#000000007")


def users_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user names after all suppliers' names, and some that are there already, were asked for."""
    time = F.lit(NOW).cast("timestamp")
    held = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), time.alias("created_at"), time.alias("updated_at"))
    new = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("username")).union(held.select("username"))
    return users.create(held, new).groupBy("username").agg(F.count("*").alias("n"))


def consistency_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of an index some of whose documents have a blank key, with the documents' ids."""
    index = tables.index(spark, sf_dir)
    number = F.substring("id", 2, 20).cast("long")
    blanked = index.withColumn("domain", F.when(number % 17 == 0, " ").otherwise(F.col("domain"))).withColumn("filename", F.when(number % 19 == 0, F.lit(None)).otherwise(F.col("filename")))
    found = consistency.compare_files(tables.files(spark, sf_dir), blanked)
    return found.select("code", "domain", "filename", F.array_join(F.array_sort("document_ids"), ",").alias("ids"))


def consistency_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues where some pages have no title: they count as unparseable, not as missing."""
    held = tables.files(spark, sf_dir)
    untitled = held.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?i)</?title>", "")).otherwise(F.col("html")))
    bad = documents(untitled)[1]
    return merge(consistency.compare_files(held, tables.index(spark, sf_dir), bad), bad).select("code", "domain", "filename")


def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are left after documents and counts were built anew."""
    return consistency.repair(tables.files(spark, sf_dir), tables.index(spark, sf_dir), tables.counted(spark, sf_dir))[2]


def rebuild_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    return built.select("id", "domain", "filename", "title", F.length("content").cast("long").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        title_extract, url_normalize, source_stats, stats_snapshot, source_share, stats_upsert, stats_decrement, task_latest, task_active,
        task_recovery, task_submit, task_http_code, users_page, consistency_files, consistency_stats, consistency_merge, consistency_report,
        delete_cascade, text_erase, search_ranked, search_frequency, search_stored, search_terms, search_matches, search_library, search_library_totals,
        search_padded, search_json, search_json_page, search_positions, search_near_terms, search_upkeep, search_typo, search_highlight, html_text, search_page, search_totals, search_crop, repair, rebuild_lenient, task_by_id,
        task_by_status, task_start, task_finish, task_run, task_create, url_check, url_grammar, stats_items, stats_replace, users_by_name, users_create, consistency_blank,
        consistency_parse,
    )
}
ORACLES = oracles.SQL
