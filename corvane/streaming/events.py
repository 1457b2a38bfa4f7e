"""Task events and continuous ingest."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TASK_EVENT


class TaskLog:
    """Events of tasks, kept in order; a listener's failure is an event, not an error."""

    def __init__(self, listeners: list[Callable[[dict], None]] = ()):
        self.listeners, self.events, self._lock, self._taken = list(listeners), [], threading.Lock(), 0

    def publish(self, task_id: str, event_type: str, scope: str = "TASK", **attributes: str) -> None:
        event = {"event_id": uuid.uuid4().hex, "task_id": task_id, "scope": scope, "event_type": event_type, "occurred_at": datetime.now(timezone.utc), "attributes": {k: str(v) for k, v in attributes.items()}}
        with self._lock:
            self.events.append(event)
        for listener in self.listeners:
            try:
                listener(event)
            except Exception as e:  # listeners must not stop tasks
                with self._lock:
                    self.events.append({**event, "event_id": uuid.uuid4().hex, "event_type": "LISTENER_FAILED", "attributes": {"message": str(e)}})

    def take(self) -> list[dict]:
        """Events since the last call."""
        with self._lock:
            new, self._taken = self.events[self._taken :], len(self.events)
        return new

    @contextmanager
    def task(self, name: str) -> Iterator[str]:
        task_id = uuid.uuid4().hex
        self.publish(task_id, "TASK_STARTED", name=name)
        try:
            yield task_id
        except Exception as e:
            self.publish(task_id, "TASK_FAILED", message=str(e))
            raise
        self.publish(task_id, "TASK_SUCCEEDED")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(e[k] for k in ("event_id", "task_id", "scope", "event_type", "occurred_at", "attributes")) for e in self.events], TASK_EVENT)


class TaskRunner:
    """Tasks in threads of their own: submit, poll, cancel.  Cancelling interrupts the task's Spark jobs."""

    def __init__(self, spark: SparkSession, log: TaskLog | None = None):
        self.spark, self.log, self.states, self._threads = spark, log or TaskLog(), {}, {}

    def submit(self, name: str, work: Callable[[], object]) -> str:
        task_id = uuid.uuid4().hex
        self.states[task_id] = {"name": name, "status": "PENDING", "result": None, "message": None}

        def run() -> None:
            state = self.states[task_id]
            if state["status"] == "CANCELLED":
                return
            self.spark.addTag(task_id)
            state["status"] = "RUNNING"
            self.log.publish(task_id, "TASK_STARTED", name=name)
            try:
                state["result"] = work()
                state["status"] = "SUCCEEDED" if state["status"] == "RUNNING" else state["status"]
            except Exception as e:  # the task's failure is its state
                state["message"] = str(e)
                state["status"] = "FAILED" if state["status"] == "RUNNING" else state["status"]
            finally:
                self.spark.removeTag(task_id)
                self.log.publish(task_id, f"TASK_{state['status']}")

        self._threads[task_id] = threading.Thread(target=run, daemon=True)
        self._threads[task_id].start()
        return task_id

    def poll(self, task_id: str) -> dict:
        return dict(self.states[task_id])

    def cancel(self, task_id: str) -> None:
        if self.states[task_id]["status"] in ("PENDING", "RUNNING"):
            self.states[task_id]["status"] = "CANCELLED"
            self.spark.interruptTag(task_id)

    def wait(self, task_id: str, seconds: float | None = None) -> dict:
        self._threads[task_id].join(seconds)
        return self.poll(task_id)

    def recover(self) -> None:
        """Tasks that no thread runs any more are failed."""
        for task_id, state in self.states.items():
            if state["status"] in ("PENDING", "RUNNING") and not self._threads[task_id].is_alive():
                state.update(status="FAILED", message="interrupted")


def ingest_stream(documents: DataFrame, ingest: Callable[[DataFrame], object], checkpoint: str):
    """A query that ingests each micro-batch of a stream of documents once; the checkpoint is where it resumes."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            ingest(rows)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_stream(spark: SparkSession, path: str, schema: str = "id string, title string, content string, metadata map<string,string>") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type, with their first and last time."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
