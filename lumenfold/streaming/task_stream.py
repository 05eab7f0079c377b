"""Archive tasks as a stream: one state per url, from submission over fetching and the file's arrival to indexing.

Events (url, kind, at, task_id, status, file_name, external_task_id, error):

* ``submit``: a url is to be archived. An active task is used again, as is a
  successful one; else a task is made and its fetch asked for.
* ``answer``: what the fetching service says of a task: running, success with a
  file name, or failed.
* ``file``: the file is there. ``indexed``: it was indexed, or failed with an error.

An event counts only for the task that the url has now, at the step it belongs
to; repeated and late ones change nothing. Limits of time are event-time timers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from lumenfold.schemas import ACTIVE, FAILED, PENDING, RUNNING, SUCCESS

EVENTS = "url string, kind string, at timestamp, task_id string, status string, file_name string, external_task_id string, error string"
CHANGES = (
    "url string, task_id string, status string, step string, action string, file_name string, external_task_id string, error string, "
    "created_at timestamp, at timestamp"
)
_STATE = "id string, status string, step string, file_name string, external_id string, error string, created long, deadline long"
#: Seconds that a fetch, and then the file, may take.
FETCH_SECONDS, FILE_SECONDS = 120, 15
_ORDER = {"submit": 0, "answer": 1, "file": 2, "indexed": 3}


def task_id(url: str, created: int) -> str:
    """The same submission always makes the same id."""
    return hashlib.sha256(f"{url}\0{created}".encode()).hexdigest()[:32]


class TaskProcessor(StatefulProcessor):
    """At most one active task of each url; a change is a row of ``CHANGES`` with the action it asks for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)

    def _row(self, url: str, task: dict, action: str, at: int) -> Row:
        when = lambda ms: pd.Timestamp(ms, unit="ms").to_pydatetime()
        return Row(
            url=url, task_id=task["id"], status=task["status"], step=task["step"], action=action, file_name=task["file_name"],
            external_task_id=task["external_id"], error=task["error"], created_at=when(task["created"]), at=when(at),
        )

    def _limit(self, task: dict, deadline: int) -> None:
        if task["deadline"]:
            self.handle.deleteTimer(task["deadline"])
        if deadline:
            self.handle.registerTimer(deadline)
        task["deadline"] = deadline

    def _step(self, url: str, task: dict | None, event: Row, at: int) -> tuple[dict | None, str]:
        """The task after an event, and the action; an empty action where nothing changes."""
        if event.kind == "submit":
            if task and at <= task["created"]:  # comes again
                return task, ""
            if task and task["status"] in (*ACTIVE, SUCCESS):
                return task, "reuse_active" if task["status"] in ACTIVE else "reuse_success"
            new = {"id": task_id(url, at), "status": PENDING, "step": "fetch", "file_name": "", "external_id": "", "error": "", "created": at, "deadline": 0}
            self._limit(new, at + 1000 * FETCH_SECONDS)
            return new, "fetch"
        if not task or task["id"] != event.task_id or task["status"] not in ACTIVE or {"answer": "fetch", "file": "file", "indexed": "index"}.get(event.kind) != task["step"]:
            return task, ""
        task["file_name"], task["external_id"] = event.file_name or task["file_name"], event.external_task_id or task["external_id"]
        if event.status == FAILED or event.error:
            self._limit(task, 0)
            task["status"], task["error"] = FAILED, event.error or "the fetch failed"
            return task, "failed"
        if event.kind == "answer":
            if event.status == RUNNING:
                changed = task["status"] != RUNNING
                task["status"] = RUNNING
                return task, "running" if changed else ""
            task["status"], task["step"] = RUNNING, "file"
            self._limit(task, at + 1000 * FILE_SECONDS)
            return task, "wait"
        self._limit(task, 0)
        if event.kind == "file":
            task["step"] = "index"
            return task, "index"
        task["status"], task["step"] = SUCCESS, "done"
        return task, "success"

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.task.get() if self.task.exists() else None
        task = dict(zip([x.split()[0] for x in _STATE.split(", ")], held, strict=True)) if held else None
        events = sorted(((int(pd.Timestamp(r.at).timestamp() * 1000), _ORDER.get(r.kind, 9), k, r) for k, r in enumerate(rows)), key=lambda x: x[:3])
        for at, _, _, event in events:
            task, action = self._step(key[0], task, event, at)
            if action:
                yield self._row(key[0], task, action, at)
        if task:
            self.task.update(tuple(task.values()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.task.exists():
            return
        task = dict(zip([x.split()[0] for x in _STATE.split(", ")], self.task.get(), strict=True))
        at = expiredTimerInfo.getExpiryTimeInMs()
        if task["status"] in ACTIVE and task["deadline"] and task["deadline"] <= at:
            task["status"], task["error"], task["deadline"] = FAILED, "timed out" if task["step"] == "fetch" else "the file did not appear", 0
            self.task.update(tuple(task.values()))
            yield self._row(key[0], task, "failed", at)

    def close(self) -> None:
        pass


def changes(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream of task changes that a stream of ``events`` causes; state is kept by RocksDB, so it need not fit in memory."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.where("url is not null and at is not null").withWatermark("at", late)
    return timed.groupBy("url").transformWithState(statefulProcessor=TaskProcessor(), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def reading(spark: SparkSession, folder: str) -> DataFrame:
    """Events from a folder of parquet files, those of :func:`answering` below it too."""
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(folder)


def answering(changed: DataFrame, fetch: Callable[[str], tuple[str, str, str]], folder: str, checkpoint: str, now: Column | None = None) -> DataStreamWriter:
    """Writer that fetches what a batch of changes asks for, by tasks, and puts the answers into the folder of events.

    ``fetch(url)`` gives (file name, external id, error). A batch that runs
    again after its answers were written does nothing, so no url is fetched
    twice for one task but by a task of the batch itself that had to be repeated.
    """

    def fetch_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [fetch(url) for url in part["url"]]
            yield part.assign(**{n: [g[k] for g in got] for k, n in enumerate(("file_name", "external_task_id", "error"))})

    def answer(batch: DataFrame, number: int) -> None:
        spark, target = batch.sparkSession, f"{folder.rstrip('/')}/answers/batch-{number}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            batch.write.format("noop").mode("overwrite").save()  # the states are to be stored all the same
            return
        asked = batch.where("action = 'fetch'").select("url", "task_id", (F.current_timestamp() if now is None else now).alias("at"))
        got = asked.mapInPandas(fetch_all, "url string, task_id string, at timestamp, file_name string, external_task_id string, error string")
        status = F.when(F.col("error") != "", FAILED).otherwise(SUCCESS)
        rows = got.select("url", F.lit("answer").alias("kind"), "at", "task_id", status.alias("status"), "file_name", "external_task_id", "error")
        rows.write.mode("overwrite").parquet(target)

    return changed.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
