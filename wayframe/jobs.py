"""Traversals whose travelers are stored, to be viewed, extended and resumed."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from .errors import NotFound
from .graph import PropertyGraph
from .plans.compiler import Frame, compile_steps, result, values
from .plans.steps import Traversal


def fingerprints(t: Traversal) -> list[str]:
    """A hash of each prefix of the steps."""
    out, h = [], hashlib.sha256()
    for k, v in t.steps:
        h.update(json.dumps({k: v}, sort_keys=True).encode() + b"\n")
        out.append(h.hexdigest())
    return out


class JobStore:
    """Jobs in a folder: travelers as Parquet, and a status file beside them that is written last."""

    def __init__(self, folder: str, workers: int = 4):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self._pool = ThreadPoolExecutor(workers)
        self._running: dict[str, Future] = {}

    def _path(self, graph: str, job: str) -> str:
        return os.path.join(self.folder, graph, job)

    def submit(self, t: Traversal, wait: bool = False) -> str:
        graph: PropertyGraph = t.graph
        job = "job-" + uuid.uuid4().hex
        os.makedirs(self._path(graph.name, job))
        frame = compile_steps(graph, t.steps)
        self._status(graph.name, job, {"id": job, "graph": graph.name, "state": "QUEUED", "query": t.to_list(), "prefixes": fingerprints(t)})
        self._running[job] = self._pool.submit(self._run, graph.name, job, frame)
        if wait:
            self._running[job].result()
        return job

    def _run(self, graph: str, job: str, f: Frame) -> None:
        s = self.get(graph, job)
        try:
            self._status(graph, job, {**s, "state": "RUNNING"})
            path = os.path.join(self._path(graph, job), "results")
            f.df.write.parquet(path)
            n = f.df.sparkSession.read.parquet(path).count()
            self._status(graph, job, {**s, "state": "COMPLETE", "count": n, "kind": f.kind, "marks": f.marks, "chosen": list(f.chosen)})
        except Exception as e:
            self._status(graph, job, {**s, "state": "ERROR", "error": str(e)})
            raise

    def _status(self, graph: str, job: str, body: dict[str, Any]) -> None:
        path = os.path.join(self._path(graph, job), "status.json")
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump(body, f)
        os.replace(path + ".new", path)

    def get(self, graph: str, job: str) -> dict[str, Any]:
        try:
            with open(os.path.join(self._path(graph, job), "status.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            raise NotFound(job) from None

    def list(self, graph: str) -> list[str]:
        folder = os.path.join(self.folder, graph)
        return sorted(x for x in os.listdir(folder) if os.path.exists(os.path.join(folder, x, "status.json"))) if os.path.isdir(folder) else []

    def search(self, t: Traversal) -> list[dict[str, Any]]:
        """Complete jobs of more than one step whose steps are how this query begins, longest first."""
        own = fingerprints(t)
        found = [self.get(t.graph.name, j) for j in self.list(t.graph.name)]
        hits = [s for s in found if s["state"] == "COMPLETE" and 1 < len(s["prefixes"]) <= len(own) and own[len(s["prefixes"]) - 1] == s["prefixes"][-1]]
        return sorted(hits, key=lambda s: -len(s["prefixes"]))

    def frame(self, graph: PropertyGraph, job: str) -> Frame:
        s = self.get(graph.name, job)
        if s["state"] != "COMPLETE":
            raise NotFound(f"{job} has no results; its state is {s['state']}")
        df = graph.spark.read.parquet(os.path.join(self._path(graph.name, job), "results"))
        return Frame(df, s["kind"], s["marks"], chosen=tuple(s["chosen"]))

    def view(self, graph: PropertyGraph, job: str) -> list[Any]:
        return values(self.frame(graph, job))

    def resume(self, graph: PropertyGraph, job: str, more: Traversal):
        """The results of more steps on the travelers of a job."""
        return result(compile_steps(graph, more.steps, start=self.frame(graph, job)))

    def run(self, t: Traversal):
        """The results of a query, from the longest stored prefix if there is one."""
        for s in self.search(t):
            n = len(s["prefixes"])
            rest = t.steps[n:]
            start = self.frame(t.graph, s["id"])
            return result(compile_steps(t.graph, rest, start=start)) if rest else result(start)
        return t.to_df()

    def delete(self, graph: str, job: str) -> None:
        self.get(graph, job)
        self._running.pop(job, None)
        shutil.rmtree(self._path(graph, job))
