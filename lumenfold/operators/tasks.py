"""Archive tasks: look-ups, the decision on a submitted url, and state changes."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.exprs import html_title, normal_url, task_http_code
from lumenfold.operators.lifecycle import Archive, wait_for_file
from lumenfold.operators.ranks import numbered
from lumenfold.schemas import ACTIVE, FAILED, PENDING, RUNNING, SUCCESS, ArchiveError
from lumenfold.session import keep


def by_id(tasks: DataFrame, task_id) -> DataFrame:
    return tasks.where(F.col("id") == task_id)


def latest(tasks: DataFrame) -> DataFrame:
    """The newest task of each url, ties to the smaller id.

    Two extremes rather than a window: both are combined before the shuffle, so
    a url with very many tasks costs no task more than others.
    """
    row = F.struct(*[F.col(c) for c in tasks.columns])
    first = tasks.groupBy("url", "created_at").agg(F.min_by(row, "id").alias("t"))
    return first.groupBy("url").agg(F.max_by("t", F.struct("created_at")).alias("t")).select("t.*")


def active(tasks: DataFrame) -> DataFrame:
    """The newest pending or running task of each url."""
    return latest(tasks.where(F.col("status").isin(*ACTIVE)))


def by_status(tasks: DataFrame, *statuses: str) -> DataFrame:
    """Tasks in some states, oldest first."""
    return tasks.where(F.col("status").isin(*statuses)).orderBy("created_at", "id")


def recovery(tasks: DataFrame) -> DataFrame:
    """Unfinished tasks in the order in which a restart takes them up: id, status, pos."""
    open_ = tasks.where(F.col("status").isin(*ACTIVE)).select("id", "status", "created_at")
    return numbered(open_, "created_at", "id").select("id", "status", "pos")


def decide(tasks: DataFrame) -> DataFrame:
    """Per url what submitting it again does: reuse the active task, the successful one, or create."""
    busy = tasks.groupBy("url").agg(F.max(F.col("status").isin(*ACTIVE)).alias("busy"))
    decision = F.when(F.col("busy"), "reuse_active").when(F.col("status") == SUCCESS, "reuse_success").otherwise("create")
    return latest(tasks).select("url", "status").join(busy, "url").select("url", decision.alias("decision"))


def submit(tasks: DataFrame, urls: DataFrame, now: Column | None = None) -> DataFrame:
    """``tasks`` with a pending task for each valid new url of ``urls`` (url) that needs one."""
    now = F.current_timestamp() if now is None else now
    wanted = urls.select(normal_url("url").alias("u")).where("u.error is null").select("u.url", "u.domain").distinct()
    needed = wanted.join(decide(tasks), "url", "left").where("decision is null or decision = 'create'")
    new = needed.select(
        F.uuid().alias("id"), "url", "domain", F.lit(PENDING).alias("status"), F.lit("").alias("file_name"), F.lit("").alias("error"),
        F.lit("").alias("external_task_id"), now.alias("created_at"), now.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    return tasks.unionByName(new)


def save(tasks: DataFrame, changed: DataFrame) -> DataFrame:
    """``tasks`` with the rows of ``changed`` in place of those of the same id."""
    return tasks.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def start(tasks: DataFrame, now: Column | None = None) -> DataFrame:
    """Unfinished tasks turned running; the first start time stays."""
    now = F.current_timestamp() if now is None else now
    return tasks.where(F.col("status") != SUCCESS).withColumns({
        "status": F.lit(RUNNING), "started_at": F.coalesce("started_at", now), "updated_at": now,
        "error": F.lit(""), "finished_at": F.lit(None).cast("timestamp"),
    })


def finish(tasks: DataFrame, outcome: DataFrame, now: Column | None = None) -> DataFrame:
    """Running tasks closed by ``outcome`` (id, file_name, external_task_id, error): an error means failed."""
    now = F.current_timestamp() if now is None else now
    failed = F.coalesce(F.col("o.error"), F.lit("")) != ""
    known = lambda name: F.when(F.coalesce(F.col(f"o.{name}"), F.lit("")) != "", F.col(f"o.{name}")).otherwise(F.col(f"t.{name}"))
    joined = tasks.alias("t").join(outcome.alias("o"), "id")
    changes = {
        "status": F.when(failed, FAILED).otherwise(SUCCESS), "error": F.when(failed, F.col("o.error")).otherwise(""),
        "file_name": known("file_name"), "external_task_id": known("external_task_id"), "updated_at": now, "finished_at": now,
    }
    return joined.select([changes.get(c, F.col(c if c == "id" else f"t.{c}")).alias(c) for c in tasks.columns])


def poll(create: Callable[[str], tuple], query: Callable[[str], tuple], url: str, seconds: float = 120.0, pause: float = 2.0) -> tuple[str, str, str]:
    """(file name, external id, error) of one url, for :func:`run`.

    Both calls give (status, file name, external id, error) of the url's external
    task; ``query`` is asked again until it succeeded or failed, or time is over.
    """
    status, name, external, error = create(url)
    end = time.monotonic() + seconds
    while status not in (SUCCESS, FAILED):
        if time.monotonic() >= end:
            return name, external, "timed out"
        time.sleep(pause)
        status, name, external, error = query(url)
    return name, external, "" if status == SUCCESS else error or "the fetch failed"


def _fetched(begun: DataFrame, fetch: Callable[[str], tuple[str, str, str]]) -> DataFrame:
    """(id, file_name, external_task_id, error) of started tasks, written once: whatever is done with it later, nothing is fetched again."""
    import pandas as pd

    def fetch_all(parts):
        for part in parts:
            got = [fetch(url) for url in part["url"]]
            yield pd.DataFrame({"id": part["id"], **{n: [g[k] for g in got] for k, n in enumerate(("file_name", "external_task_id", "error"))}})

    outcome = begun.select("id", "url").mapInPandas(fetch_all, "id string, file_name string, external_task_id string, error string")
    return keep(outcome, "outcome")


def run(tasks: DataFrame, fetch: Callable[[str], tuple[str, str, str]]) -> DataFrame:
    """All unfinished tasks fetched with ``fetch(url) -> (file name, external id, error)``, in parallel over partitions, once each."""
    begun = keep(start(tasks.where(F.col("status").isin(*ACTIVE))), "begun")
    return save(tasks, keep(finish(begun, _fetched(begun, fetch)), "finished"))


def process(tasks: DataFrame, fetch: Callable[[str], tuple[str, str, str]], archive: Archive, seconds: float = 15.0) -> DataFrame:
    """All unfinished tasks taken through: fetched, their files waited for in the archive's folder, indexed and moved to their domain.

    Tasks wait for the files, read them and move them; a task whose fetch failed,
    whose file does not appear within ``seconds``, or whose page has no title
    fails with that error, its file name and external id kept.
    """
    import pandas as pd

    root = archive.root

    def arrive(parts):
        for part in parts:
            html, problem = [], []
            for name in part["file_name"]:
                try:
                    with open(wait_for_file(os.path.join(root, name) if name else "", seconds, min(0.5, seconds or 0.1)), encoding="utf-8", errors="replace", newline="") as file:
                        html.append(file.read()), problem.append("")
                except ArchiveError as error:
                    html.append(None), problem.append(f"no file: {error}")
            yield part.assign(html=html, problem=problem)

    def move(parts):
        for part in parts:
            for domain, name in zip(part["domain"], part["file_name"], strict=True):
                if os.path.exists(source := os.path.join(root, name)):
                    os.replace(source, os.path.join(root, domain, name))
            yield part[["id"]]

    begun = keep(start(tasks.where(F.col("status").isin(*ACTIVE))), "begun")
    outcome = _fetched(begun, fetch)
    there = outcome.where("coalesce(error, '') = ''").join(begun.select("id", "domain"), "id").select("id", "domain", "file_name")
    arrived = there.mapInPandas(arrive, "id string, domain string, file_name string, html string, problem string")
    untitled = (F.col("problem") == "") & html_title("html").isNull()
    read = keep(arrived.withColumn("problem", F.when(untitled, "no title found").otherwise(F.col("problem"))), "arrived")
    good = read.where("problem = ''")
    if good.head(1):
        archive.add(good.select("domain", F.col("file_name").alias("filename"), "html"))
        keep(good.select("id", "domain", "file_name").mapInPandas(move, "id string"), "moved")
    failed = read.where("problem <> ''").select("id", "problem")
    whole = outcome.join(failed, "id", "left").select("id", "file_name", "external_task_id", F.coalesce("problem", "error", F.lit("")).alias("error"))
    return save(tasks, keep(finish(begun, whole), "finished"))


def response(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", task_http_code("status").cast("long").alias("code"))
