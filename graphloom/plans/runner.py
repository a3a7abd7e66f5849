"""Runs passes over a graph in the order of their dependencies."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Literal

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from graphloom.bundle import GraphBundle
from graphloom.schema import NODES

Status = Literal["success", "failed", "timeout", "skipped"]


@dataclass(frozen=True)
class Pass:
    """``run`` changes tables of the graph and returns statistics."""

    name: str
    run: Callable[[GraphBundle], dict]
    needs: tuple[str, ...] = ()
    enabled: bool = True
    on_error: Literal["continue", "abort"] = "continue"
    timeout: float | None = None


@dataclass
class Record:
    name: str
    status: Status
    started: float
    seconds: float = 0.0
    stats: dict = field(default_factory=dict)
    error: str | None = None


#: Seconds for which the jobs of a pass that ran out of time are cancelled again and again.
GRACE = 60.0


def ordered(passes: list[Pass]) -> list[Pass]:
    """Passes after what they need, else as given. Twice a name, unknown needs and cycles fail."""
    names = [p.name for p in passes]
    if len(set(names)) < len(names):
        raise ValueError(f"pass registered twice: {sorted({n for n in names if names.count(n) > 1})}")
    for p in passes:
        if unknown := set(p.needs) - set(names):
            raise ValueError(f"{p.name} needs unknown passes: {sorted(unknown)}")
    done: list[Pass] = []
    rest = list(passes)
    while rest:
        ready = [p for p in rest if set(p.needs) <= {d.name for d in done}]
        if not ready:
            raise ValueError(f"cycle among passes: {sorted(p.name for p in rest)}")
        done.append(ready[0])
        rest.remove(ready[0])
    return done


def _with_timeout(spark: SparkSession, job: Callable[[], dict], seconds: float) -> tuple[Status, dict, str | None]:
    """The job's outcome; if it takes longer its Spark jobs are cancelled, with their tasks."""
    sc, group, out = spark.sparkContext, f"pass-{uuid.uuid4().hex}", {}

    def body() -> None:
        sc.setJobGroup(group, "pass", interruptOnCancel=True)
        try:
            out["stats"] = job() or {}
        except Exception as e:  # noqa: BLE001  a pass may fail in any way; others go on
            out["error"] = str(e)

    worker = InheritableThread(target=body, daemon=True)
    worker.start()
    worker.join(seconds if seconds > 0 else None)
    if worker.is_alive():
        ends = time.time() + GRACE
        while worker.is_alive() and time.time() < ends:  # a job may start only after the first call
            sc.cancelJobGroup(group)
            worker.join(0.5)
        return "timeout", {}, f"took more than {seconds:g} s"
    return ("failed", {}, out["error"]) if "error" in out else ("success", out["stats"], None)


def run(graph: GraphBundle, passes: list[Pass], timeout: float = 300.0) -> list[Record]:
    """A record of each pass. What depends on a pass without success is skipped."""
    records: dict[str, Record] = {}
    aborted = False
    for p in ordered(passes):
        start = time.time()
        if aborted or not p.enabled or any(records[n].status != "success" for n in p.needs):
            records[p.name] = Record(p.name, "skipped", start)
            continue
        status, stats, error = _with_timeout(graph.spark, lambda p=p: p.run(graph), timeout if p.timeout is None else p.timeout)
        records[p.name] = Record(p.name, status, start, time.time() - start, stats, error)
        aborted = status != "success" and p.on_error == "abort"
    return list(records.values())


def as_table(spark: SparkSession, records: list[Record], repo: str) -> DataFrame:
    """Records as rows of ``pass_runs``."""
    run_id = uuid.uuid4().hex
    rows = [(run_id, repo, r.name, r.status, r.started, int(r.seconds * 1000), json.dumps(r.stats, default=str), r.error) for r in records]
    raw = spark.createDataFrame(rows, "runId string, repo string, pass string, status string, startedAt double, durationMs long, stats string, error string")
    return raw.selectExpr("runId", "repo", "pass", "status", "timestamp_seconds(startedAt) AS startedAt", "durationMs", "stats", "error").select(*[c.split(" ")[0] for c in NODES["pass_runs"][1].split(", ")])
