"""Analyses as jobs: each runs in a thread under a Spark tag, reports progress, can be cancelled, and leaves its result as JSON."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surprisal.alphabet import ENGLISH, Alphabet
from surprisal.functions.text import entropy_of_counts, redundancy_of
from surprisal.models import PPM, Huffman
from surprisal.models.ppm import context_edges
from surprisal.operators.counts import char_counts


class Status(StrEnum):
    PENDING, RUNNING, COMPLETED, FAILED, CANCELED = "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELED"


@dataclass
class JobSpec:
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass
class JobState:
    status: Status = Status.PENDING
    progress: float = 0.0
    result: dict[str, Any] | None = None
    error: str | None = None


def _segments(documents: DataFrame, alphabet: Alphabet) -> DataFrame:
    return documents.select(F.col(documents.columns[0]).alias("seg_id"), alphabet.column(F.col("text")).alias("text"))


def job_entropy(documents: DataFrame, alphabet: Alphabet = ENGLISH, **_: Any) -> dict[str, Any]:
    """Symbols by falling count, and their entropy."""
    counts = char_counts(_segments(documents, alphabet)).persist()
    top = counts.orderBy(F.desc("cnt"), "ch").collect()
    h = counts.agg(entropy_of_counts().alias("h")).first()["h"]
    counts.unpersist()
    return {"x": [r["ch"] for r in top], "y": [r["cnt"] for r in top], "entropy": h, "log2_alphabet_size": alphabet.log2_size, "redundancy": redundancy_of(h, alphabet.log2_size), "total": sum(r["cnt"] for r in top)}


def job_huffman(documents: DataFrame, alphabet: Alphabet = ENGLISH, **_: Any) -> dict[str, Any]:
    """Codes by length and symbol."""
    model = Huffman(alphabet).fit(_segments(documents, alphabet))
    return {"codes": [{"symbol": c["ch"], "code": c["code"], "length": c["code_len"], "count": c["cnt"]} for c in model.codes()], **model.values}


def job_ppm(documents: DataFrame, alphabet: Alphabet = ENGLISH, depth: int = 5, top: int = 100, charted: int = 30, **_: Any) -> dict[str, Any]:
    """Entropy of the training text itself, its most frequent contexts and which extends which."""
    segments = _segments(documents, alphabet)
    model = PPM(alphabet, depth).fit(segments).cached()
    found = model.top_contexts(top).persist()
    rows, edges = found.collect(), context_edges(found).collect()
    h, size = model.evaluate(segments), model.context_tree_size()
    found.unpersist(), model.released()
    return {"bits_per_char": h, "redundancy": redundancy_of(h, alphabet.log2_size), "context_tree_size": size, "top_labels": [r["ctx"] for r in rows[:charted]], "top_values": [r["n"] for r in rows[:charted]], "nodes": [{"id": r["ctx"], "total": r["n"]} for r in rows], "edges": [{"source": e["parent"], "target": e["child"]} for e in edges]}


def job_proof(documents: DataFrame, lang: str = "en", corpus: str = "text8", snapshot: str = "2025-10-01", **options: Any) -> dict[str, Any]:
    """A report over saved results."""
    from surprisal.plans.report import generate_report

    return {k: str(v) for k, v in generate_report(documents.sparkSession, lang, corpus, snapshot, **options).items()}


KINDS: dict[str, Callable[..., dict[str, Any]]] = {"entropy": job_entropy, "huffman": job_huffman, "ppm": job_ppm, "proof": job_proof}


class JobRunner:
    """Runs jobs over documents; artifacts, if a folder is given, are {job_id}.json of spec, status and result."""

    def __init__(self, spark: SparkSession, documents: DataFrame, workers: int = 4, artifacts: str | None = None) -> None:
        self.spark, self.documents, self.artifacts = spark, documents, artifacts
        self.pool, self.lock = ThreadPoolExecutor(workers), threading.Lock()
        self.specs: dict[str, JobSpec] = {}
        self.states: dict[str, JobState] = {}
        self.futures: dict[str, Future] = {}

    def submit(self, kind: str, params: dict[str, Any] | None = None, name: str = "") -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
        spec = JobSpec(kind, params or {}, name or kind)
        self.specs[spec.job_id], self.states[spec.job_id] = spec, JobState()
        self.futures[spec.job_id] = self.pool.submit(self._run, spec)
        return spec.job_id

    def _run(self, spec: JobSpec) -> None:
        state = self.states[spec.job_id]
        with self.lock:
            if state.status == Status.CANCELED:
                return
            state.status = Status.RUNNING
        self.spark.addTag(spec.job_id)
        self.spark.sparkContext.addJobTag(spec.job_id)
        try:
            state.result = KINDS[spec.kind](self.documents, **spec.params)
            with self.lock:
                if state.status != Status.CANCELED:
                    state.status, state.progress = Status.COMPLETED, 1.0
        except Exception as e:  # a job's failure is its result
            with self.lock:
                if state.status != Status.CANCELED:
                    state.status, state.error = Status.FAILED, str(e)
        finally:
            self.spark.removeTag(spec.job_id)
            self.spark.sparkContext.removeJobTag(spec.job_id)
            if self.artifacts:
                Path(self.artifacts).mkdir(parents=True, exist_ok=True)
                Path(self.artifacts, f"{spec.job_id}.json").write_text(json.dumps({"spec": asdict(spec), "status": state.status, "result": state.result}, default=str), encoding="utf-8")

    def progress(self, job_id: str) -> float:
        """The share of tasks done, of those of the stages known so far; 1 only when the job is."""
        state = self.states[job_id]
        if state.status == Status.RUNNING:
            tracker, of_tag = self.spark.sparkContext.statusTracker(), self.spark.sparkContext._jsc.sc().statusTracker()
            jobs = filter(None, map(tracker.getJobInfo, of_tag.getJobIdsForTag(job_id)))
            stages = [s for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s]
            share = sum(s.numCompletedTasks for s in stages) / max(1, sum(s.numTasks for s in stages))
            with self.lock:
                if state.status == Status.RUNNING:
                    state.progress = max(state.progress, min(share, 0.99))
        return state.progress

    def cancel(self, job_id: str) -> None:
        with self.lock:
            if self.states[job_id].status in (Status.PENDING, Status.RUNNING):
                self.states[job_id].status = Status.CANCELED
        self.futures[job_id].cancel()
        self.spark.interruptTag(job_id)

    def wait(self, job_id: str, timeout: float | None = None) -> JobState:
        if not self.futures[job_id].cancelled():
            self.futures[job_id].result(timeout)
        return self.states[job_id]
