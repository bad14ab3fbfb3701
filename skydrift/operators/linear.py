"""Many linear probes fitted together: one pass over the rows per Newton step.

A probe separates the rows of some sources from those of others. Variants, layers and
folds make hundreds of such problems over the same rows, so rows are tabled once by
``source`` and every problem names the sources that it takes. A pass returns, for each
problem and fold not yet at its optimum, the loss, the gradient and the curvature, a few
thousand sums each; the driver takes one Newton step per problem and hands the weights
back. Sums per task are bounded by the number of problems, not by rows.

Losses are those of the usual defaults at C = 1: ``logistic`` with a free intercept, and
``squared_hinge`` with the intercept under the penalty like any weight. Every fit ends
at its optimum, which the largest component of its gradient shows; one that does not
get there raises.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows taken at once in a task.
CHUNK = 2048


@dataclass(frozen=True)
class Problem:
    """Sources with the label of their rows; None where a row's own ``label`` counts."""

    name: str
    sources: Mapping[str, float | None]


@dataclass
class Probe:
    """One fitted problem: a row of weights per fold, intercept last, on ``(x - shift) / scale``."""

    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    gradient: float = np.inf
    steps: int = 0


def _moments(rows: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per source: rows, mean and summed squared deviation of every component."""
    v = array_to_vector("x")
    m = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(v)).alias("m"), vector_to_array(Summarizer.variance(v)).alias("v"))
    return {r.source: (r.n, np.array(r.m), np.array(r.v) * max(r.n - 1, 0)) for r in m.collect()}


def _pooled(parts: Sequence[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation over several sources; a constant component keeps scale 1."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    spread = np.sqrt(sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts) / n)
    return mean, np.where(spread > 0, spread, 1.0)


def _by_source(batches: Iterator[pa.RecordBatch], wanted: set[str]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """Chunks of rows of one source, with their vectors."""
    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK):
            chunk = whole.slice(start, CHUNK)
            source = np.array(chunk.column("source").to_pylist(), dtype=object)
            for s in dict.fromkeys(source):
                if s in wanted:
                    some = chunk.filter(pa.array(source == s))
                    yield s, some, some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)


def _labels(given: float | None, some: pa.RecordBatch) -> np.ndarray:
    return np.full(some.num_rows, given) if given is not None else some.column("label").to_numpy(zero_copy_only=False)


def _design(x: np.ndarray, probe: Probe) -> np.ndarray:
    return np.column_stack([(x - probe.shift) / probe.scale, np.ones(len(x))])


def _state(x: np.ndarray, y: np.ndarray, w: np.ndarray, loss: str) -> np.ndarray:
    """Loss, gradient and curvature at ``w`` in one line of numbers."""
    z = x @ w
    if loss == "logistic":
        p = 0.5 * (1.0 + np.tanh(0.5 * z))
        value, slope, bend = np.logaddexp(0.0, z).sum() - (y * z).sum(), p - y, p * (1.0 - p)
    else:
        sign = 2.0 * y - 1.0
        gap = np.maximum(1.0 - sign * z, 0.0)
        value, slope, bend = (gap * gap).sum(), -2.0 * sign * gap, 2.0 * (gap > 0)
    return np.concatenate([[value, len(y)], x.T @ slope, (x.T @ (x * bend[:, None])).ravel()])


def _pass(rows: DataFrame, problems: Sequence[Problem], probes: Mapping[str, Probe], open_: Mapping[str, list[int]], loss: str) -> dict[tuple[str, int], np.ndarray]:
    """One scan: the summed state of every open problem and fold. A row counts for all folds but its own."""
    mine = [p for p in problems if open_.get(p.name)]
    wanted = {s for p in mine for s in p.sources}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for source, some, x in _by_source(batches, wanted):
            fold = some.column("fold").to_numpy()
            for p in mine:
                if source in p.sources:
                    probe = probes[p.name]
                    design, y = _design(x, probe), _labels(p.sources[source], some)
                    for k in open_[p.name]:
                        train = fold != k
                        state = _state(design[train], y[train], probe.weights[k], loss)
                        at = (p.name, k)
                        sums[at] = sums[at] + state if at in sums else state
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["name", "fold", "state"])

    parts = rows.select("source", "fold", "label", "x").mapInArrow(add, "name string, fold int, state array<double>")
    total = parts.groupBy("name", "fold").agg(vector_to_array(Summarizer.sum(array_to_vector("state"))).alias("state"))
    return {(r.name, r.fold): np.array(r.state) for r in total.collect()}  # a line per problem and fold


def fit(rows: DataFrame, problems: Sequence[Problem], loss: str = "logistic", folds: int = 5, scale: str = "none", tol: float = 1e-8, max_steps: int = 100) -> dict[str, Probe]:
    """Fits every problem once per fold on the rows outside that fold.

    ``rows`` is (source, fold, label, x), read once per step; store it. ``scale`` is
    ``none`` or ``pooled`` (z-scores over all rows of a problem). With ``folds`` of 1,
    rows with fold -1 are fitted on and those with fold 0 are held out. A step that
    raises the objective is halved. Ends when no component of the gradient per row
    exceeds ``tol``.
    """
    if loss not in ("logistic", "squared_hinge"):
        raise ValueError(f"no loss {loss!r}")
    moments = _moments(rows)
    probes: dict[str, Probe] = {}
    for p in problems:
        parts = [moments[s] for s in p.sources if s in moments]
        if not parts:
            raise ValueError(f"{p.name}: none of its sources has rows")
        d = len(parts[0][1])
        shift, spread = _pooled(parts) if scale == "pooled" else (np.zeros(d), np.ones(d))
        probes[p.name] = Probe(np.zeros((folds, d + 1)), shift, spread, gradient=0.0)
    open_ = {p.name: list(range(folds)) for p in problems}
    base: dict[tuple[str, int], tuple[np.ndarray, float, np.ndarray]] = {}  # where a step started, its objective, the step
    for step in range(max_steps + 1):
        states = _pass(rows, problems, probes, open_, loss)
        for (name, k), s in states.items():
            probe = probes[name]
            w, size = probe.weights[k].copy(), probe.weights.shape[1]
            penalty = np.ones(size)
            if loss == "logistic":
                penalty[-1] = 0.0
            value, slope = s[0] + 0.5 * (penalty * w * w).sum(), s[2:2 + size] + penalty * w
            if (name, k) in base and value > base[name, k][1] * (1 + 1e-12) + 1e-12:
                start, before, move = base[name, k]
                base[name, k] = start, before, move / 2
                probe.weights[k] = start + move / 2
                continue
            worst = float(np.abs(slope).max() / max(s[1], 1.0))
            if worst <= tol:
                probe.gradient = max(probe.gradient, worst)
                open_[name].remove(k)
                continue
            bend = s[2 + size:].reshape(size, size) + np.diag(penalty + 1e-12)
            move = -np.linalg.solve(bend, slope)
            base[name, k] = w, value, move
            probe.weights[k] = w + move
        for name in {n for n, _ in states}:
            probes[name].steps = step
        if not any(open_.values()):
            return probes
    raise RuntimeError(f"no optimum after {max_steps} steps: {sorted(n for n, k in open_.items() if k)}")


def held_out(rows: DataFrame, problems: Sequence[Problem], probes: Mapping[str, Probe], keep: Sequence[str] = ()) -> DataFrame:
    """(name, source, fold, label, score, keep...): every row under the probe that did not see it; above 0 means label 1."""
    keep = list(keep)
    wanted = {s for p in problems for s in p.sources}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, some, x in _by_source(batches, wanted):
            fold = some.column("fold").to_numpy()
            seen = fold < 0
            for p in problems:
                if source in p.sources:
                    probe = probes[p.name]
                    score = np.einsum("ij,ij->i", _design(x, probe), probe.weights[np.maximum(fold, 0)])
                    out = pa.RecordBatch.from_arrays(
                        [pa.array([p.name] * len(x)), pa.array([source] * len(x)), pa.array(fold, pa.int32()), pa.array(_labels(p.sources[source], some)), pa.array(score), *(some.column(c) for c in keep)],
                        ["name", "source", "fold", "label", "score", *keep])
                    yield out.filter(pa.array(~seen))

    schema = ", ".join(["name string, source string, fold int, label double, score double", *(f"{c} {kinds[c]}" for c in keep)])
    return rows.select("source", "fold", "label", "x", *keep).mapInArrow(run, schema)


def summary(rows: DataFrame, probes: Mapping[str, Probe]) -> DataFrame:
    """(name, gradient, steps): how close to its optimum every problem ended."""
    table = pd.DataFrame([(n, p.gradient, p.steps) for n, p in probes.items()], columns=["name", "gradient", "steps"])
    return rows.sparkSession.createDataFrame(table, "name string, gradient double, steps int")
