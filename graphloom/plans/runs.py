"""Runs in the background: started at once, asked for by id, kept as rows of ``runs``."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.bundle import GraphBundle
from graphloom.schema import TABLES


class Runs:
    """Runs of one graph. Each has a job group of its own, so that it can be cancelled.

    Rows that say ``running`` when the object is made are of a process that ended: they have failed.
    There are as many records as runs; the driver holds them, and nothing of what runs find.
    """

    def __init__(self, graph: GraphBundle):
        self.graph, self._lock, self._threads = graph, threading.Lock(), {}
        kept = graph["runs"].withColumns({c: F.unix_micros(c) / 1e6 for c in ("startedAt", "endedAt")}).collect()
        self._records = {r["runId"]: r.asDict() for r in kept}
        for r in self._records.values():
            if r["status"] == "running":
                r.update(status="failed", error="its process ended")

    def start(self, kind: str, job: Callable[[str], dict], wait: bool = False) -> str:
        """Starts ``job`` (a function of the run's id that returns statistics), and returns the id."""
        run_id = uuid.uuid4().hex
        self._put(run_id, kind=kind, status="running", startedAt=time.time(), endedAt=None, stats="{}", error=None)

        def body() -> None:
            self.graph.spark.sparkContext.setJobGroup(f"run-{run_id}", kind, interruptOnCancel=True)
            try:
                end = {"status": "completed", "stats": json.dumps(job(run_id) or {}, default=str)}
            except Exception as e:  # noqa: BLE001  a run may fail in any way, and its record tells how
                end = {"status": "failed", "error": str(e)[:2000]}
            with self._lock:
                stopped = self._records[run_id]["status"] != "running"
            if not stopped:
                self._put(run_id, endedAt=time.time(), **end)

        self._threads[run_id] = InheritableThread(target=body, daemon=True)
        self._threads[run_id].start()
        if wait:
            self.wait(run_id)
        return run_id

    def wait(self, run_id: str, seconds: float | None = None) -> str:
        """Waits for a run and returns its status."""
        if run_id in self._threads:
            self._threads[run_id].join(seconds)
        return self._records[run_id]["status"]

    def cancel(self, run_id: str) -> None:
        """Ends a run's jobs; its status is ``cancelled``."""
        if self._records[run_id]["status"] == "running":
            self._put(run_id, status="cancelled", endedAt=time.time())
            self.graph.spark.sparkContext.cancelJobGroup(f"run-{run_id}")

    def status(self, run_id: str, kind: str | None = None) -> DataFrame:
        """The row of a run; an unknown id, or one of another kind, is an error."""
        if run_id not in self._records or kind not in (None, self._records[run_id]["kind"]):
            raise KeyError(f"no {kind or ''} run with id {run_id!r}")
        return self.graph["runs"].where(F.col("runId") == run_id)

    def _put(self, run_id: str, **values) -> None:
        with self._lock:
            self._records[run_id] = self._records.get(run_id, {"runId": run_id}) | values
            ddl = TABLES["runs"][1].replace("timestamp", "double")
            names = [c.split(" ")[0] for c in ddl.split(", ")]
            rows = self.graph.spark.createDataFrame([tuple(r[n] for n in names) for r in self._records.values()], ddl)
            self.graph["runs"] = rows.withColumns({c: F.timestamp_seconds(c) for c in ("startedAt", "endedAt")})


def of(graph: GraphBundle) -> Runs:
    """The runs of a graph, made when first asked for."""
    if getattr(graph, "runs", None) is None:
        graph.runs = Runs(graph)
    return graph.runs


def latest(runs: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (runId and more) of the newest completed run of a kind; none if there is none."""
    newest = runs.where((F.col("kind") == kind) & (F.col("status") == "completed")).agg(F.max_by("runId", F.struct("startedAt", "runId")).alias("runId"))
    return rows.join(newest, "runId", "left_semi")
