"""Toxicity from two class-conditional Kneser-Ney models of words and word sequences.

Labelled documents give counts of expressions: the letters of a word from its start
on, one letter more at a time, and sequences of two and three words. Every count is
a number of documents. In each class an expression's last unit (a letter, or a word)
follows its head with a Kneser-Ney probability: counts are discounted, and what the
discount frees, with ``STRENGTH`` more, goes to the counts shared by both classes,

    P_c(x | h) = (max(n_c(hx) - d_c, 0) + (d_c * kinds_c(h) + STRENGTH) * S(x | h)) / (n_c(h) + STRENGTH),

so that an expression seen once says little, and forms of one expression support
each other through their common start. For sequences the shared part leans towards
the class that the shorter sequence speaks for, so there P is not summed to 1.

An expression's evidence is the logarithm of the ratio of its two probabilities,
summed along the letters for a word; expressions in fewer than two documents back
off to the next shorter one. A document's measures are its evidence per word, the
parts from words with strong evidence, the strongest word, and what sequences add; a
logistic curve fitted on labelled documents that the counts have not seen makes a
probability of them.

The sample of labelled documents is bounded by ``max_docs`` per class, hence so is
the model; scoring reads every document.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import fold_of

_MARKS = string.punctuation.encode() + b"\x00\x02\x1c\x1d\x1e\x1f"
_TABLE = bytes.maketrans(_MARKS + string.ascii_uppercase.encode(), b" " * len(_MARKS) + string.ascii_lowercase.encode())
_END = b"\x02"
STRENGTH = 5.0
ORDER = 3
ROOT = np.uint64(0)
_LETTER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 2**64)


def tokens(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lowered."""
    return (text or "").encode().translate(_TABLE).split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))[:n]


def stems(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of all starts of the words, an end mark being the last letter; each start's word; where each word's starts begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    letters = np.frombuffer(_END.join(words) + _END, np.uint8)
    starts = np.cumsum(sizes) - sizes
    sums = np.cumsum(_LETTER[letters] * _powers(_BASE, len(letters)))
    before = np.append(ROOT, sums)[starts]
    return (sums - np.repeat(before, sizes)) * np.repeat(_powers(_INVERSE, len(letters))[starts], sizes), np.repeat(np.arange(len(words)), sizes), starts


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Keys of the sequences of ``n`` words, from the words' own keys."""
    key = words[: len(words) - n + 1]
    for j in range(1, n):
        key = (key ^ (key >> np.uint64(29))) * _MIX + words[j : len(words) - n + 1 + j]
    return key


def expressions(words: list[bytes]) -> np.ndarray:
    """Rows ``level, key, head, shorter`` of a text's different expressions.

    Levels 2 and 3 are sequences, lower ones stems: minus the number of letters.
    ``shorter`` is the sequence without its first word, and the stem's head again.
    """
    kinds, at = np.unique(np.array(words, object), return_inverse=True)
    key, word, starts = stems(kinds.tolist())
    place = np.arange(len(key)) - starts[word]
    head = np.append(ROOT, key[:-1])
    head[starts] = ROOT
    rows = [np.stack([-1 - place, key.view(np.int64), head.view(np.int64), head.view(np.int64)])]
    of = key[np.append(starts[1:], len(key)) - 1][at]
    shorter = of
    for n in range(2, min(ORDER, len(of)) + 1):
        longer = sequences(of, n)
        rows.append(np.stack([np.full(len(longer), n), longer.view(np.int64), (sequences(of, n - 1)[:-1]).view(np.int64), shorter[1:].view(np.int64)]))
        shorter = longer
    rows = np.concatenate(rows, axis=1)
    return rows[:, np.unique(rows[1], return_index=True)[1]]


def count_expressions(sample: DataFrame) -> DataFrame:
    """``level, key, head, shorter`` and the numbers ``t`` and ``o`` of toxic and ordinary documents, for expressions in two documents or more."""
    names = ["level", "key", "head", "shorter"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = tokens(text)
                if words:
                    rows = expressions(words)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.full(rows.shape[1], toxic, np.int64))], [*names, "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(count, ", ".join(f"{n} long" for n in [*names, "toxic"]))
    return rows.groupBy("key").agg(*(F.min(n).alias(n) for n in ("level", "head", "shorter")), F.sum("toxic").cast("int").alias("t"), F.sum(1 - F.col("toxic")).cast("int").alias("o")).where("t + o >= 2")


def look_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class KneserNey:
    """Evidence of words and sequences: log-likelihood ratio, toxic to ordinary."""

    def __init__(self, counts: pa.Table):
        order = np.argsort(counts["key"].to_numpy().view(np.uint64))
        level, key, head, shorter, toxic, ordinary = (counts[n].to_numpy()[order] for n in ("level", "key", "head", "shorter", "t", "o"))
        self.keys, head, shorter = (x.view(np.uint64) for x in (key, head, shorter))
        n = np.stack([toxic, ordinary])
        self.values = np.zeros(len(order))
        below = look_up(self.keys, shorter)
        for at in (np.flatnonzero(level < 0), *(np.flatnonzero(level == k) for k in range(2, ORDER + 1))):
            if not len(at):
                continue
            _, of = np.unique(head[at], return_inverse=True)
            own, shared = [], n[:, at].sum(0)
            shared = shared / np.bincount(of, weights=shared)[of]
            for c in (0, 1):
                m = n[c, at]
                once, twice = float((m == 1).sum()), float((m == 2).sum())
                d = once / (once + 2 * twice) if once and twice else 0.5
                whole, kinds = np.bincount(of, weights=m)[of], np.bincount(of, weights=m > 0)[of]
                own.append((np.maximum(m - d, 0), (d * kinds + STRENGTH) * shared, whole + STRENGTH))
            ratio = lambda lean: np.log((own[0][0] + own[0][1] * np.exp(lean / 2)) / own[0][2]) - np.log((own[1][0] + own[1][1] * np.exp(-lean / 2)) / own[1][2])  # noqa: E731, B023
            if level[at[0]] < 0:
                step = np.zeros(len(order))
                step[at] = ratio(0.0)
                self._along(level, at, below, step)
            else:
                self.values[at] = ratio(np.where(below[at] >= 0, self.values[below[at]], 0.0))

    def _along(self, level: np.ndarray, at: np.ndarray, below: np.ndarray, step: np.ndarray) -> None:
        """A stem's evidence is that of its head and its own step."""
        at = at[np.argsort(-level[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(np.diff(level[at])) + 1):
            self.values[part] = step[part] + np.where(below[part] >= 0, self.values[below[part]], 0.0)

    def evidence(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Evidence of the words' longest known starts, and the words' keys."""
        key, _, starts = stems(words)
        at = look_up(self.keys, key)
        last = np.maximum.reduceat(np.where(at >= 0, np.arange(len(key)), -1), starts)
        return np.where(last >= 0, self.values[at[last]], 0.0), key[np.append(starts[1:], len(key)) - 1]

    def in_sequence(self, words: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Evidence of a text's words where the longest known sequence that ends there replaces that of the word alone."""
        out = single.copy()
        for n in range(2, min(ORDER, len(words)) + 1):
            at = look_up(self.keys, sequences(words, n))
            out[n - 1 :] = np.where(at >= 0, self.values[at], out[n - 1 :])
        return out


LOW, HIGH = 1.0, 2.0
MEASURES = 7


class Scorer(dict):
    """Measures of texts; keeps evidence and key of at most ``limit`` words."""

    def __init__(self, model: KneserNey, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """Per text: words, evidence, that beyond ``LOW`` and ``HIGH``, the strongest, what sequences add, that beyond ``LOW``."""
        out = np.zeros((len(texts), MEASURES))
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, text in enumerate(texts):
            w = tokens(text)
            if w:
                group.append((i, w))
                held += len(w)
            if held > 100_000:
                self._fill(group, out)
                group, held = [], 0
        self._fill(group, out)
        return out

    def _fill(self, group: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        if len(self) > self.limit:
            self.clear()
        new = list({x for _, w in group for x in w if x not in self})
        if new:
            evidence, keys = self.model.evidence(new)
            self.update(zip(new, zip(evidence.tolist(), keys.tolist())))
        for i, w in group:
            e, keys = zip(*map(self.__getitem__, w))
            e = np.array(e)
            more = self.model.in_sequence(np.array(keys, np.uint64), e) - e
            out[i] = len(w), e.sum(), np.maximum(e - LOW, 0).sum(), np.maximum(e - HIGH, 0).sum(), max(e.max(), 0), more.sum(), np.maximum(more - LOW, 0).sum()


def features(m: np.ndarray) -> np.ndarray:
    n = np.maximum(m[:, 0], 1)
    return np.stack([m[:, 1] / n, np.log1p(m[:, 2]), 10 * m[:, 2] / n, np.log1p(m[:, 3]), 10 * m[:, 3] / n, m[:, 4], m[:, 5] / n, np.log1p(m[:, 6]), np.log(n), np.ones(len(n))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """``text``, ``toxic``, ``curve``: labelled documents outside the held-out fold, the smallest hashes of each class.

    ``curve`` marks the fold the counts do not see.
    """
    known = labels.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("id")) != 0)).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(max_docs) for c in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_docs ids at most
    return docs.join(picked, "id").select("text", "toxic", (fold_of(F.col("id")) == 4).alias("curve"))


def train(docs: DataFrame, labels: DataFrame, max_docs: int) -> tuple[KneserNey | None, np.ndarray, float]:
    """The models, the curve, and the score where there is nothing to go by."""
    sample = stored(training_sample(docs, labels, max_docs), "labelled")
    counted = sample.where("NOT curve").dropDuplicates(["text", "toxic"])
    if {r["toxic"] for r in counted.select("toxic").distinct().collect()} != {0, 1}:
        return None, np.zeros(0), float(not counted.where("toxic = 1").isEmpty())
    model = KneserNey(count_expressions(counted).toArrow())  # bounded with the sample
    held = measured(sample.where("curve").select("toxic", "text"), model).select("toxic", "m").toPandas()
    y = held["toxic"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return model, np.array([10.0, *np.zeros(9)]), 0.5
    return model, fit_curve(features(np.stack(held["m"].to_numpy())), y), float(y.mean())


def measured(docs: DataFrame, model: KneserNey) -> DataFrame:
    """The rows of ``docs`` with ``m``, the measures of their ``text``, in its place."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            m = scorer.measures(b.column("text").to_pylist())
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(list(m), pa.list_(pa.float64()))], [*keep, "m"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, schema + ", m array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 3_000) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``words``, ``evidence``, ``score`` and ``predicted``.

    Labels of the held-out fold are never read; of contradicting labels the highest
    holds, null ones do not count. Null and empty texts have no evidence and score
    what the curve says of nothing. Without labels of both classes every score is
    0, or 1 if there are toxic ones only. Repeated rows score alike, each for itself.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model, curve, prior = train(docs, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")), max_docs)
    if model is None:
        out = docs.select("id", F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("evidence"), F.lit(prior).alias("score"))
    else:
        m = F.col("m")
        n = F.greatest(m[0], F.lit(1.0))
        x = [m[1] / n, F.log1p(m[2]), 10 * m[2] / n, F.log1p(m[3]), 10 * m[3] / n, m[4], m[5] / n, F.log1p(m[6]), F.log(n), F.lit(1.0)]
        odds = sum((F.lit(float(w)) * f for w, f in zip(curve, x)), F.lit(0.0))
        out = measured(docs, model).select("id", m[0].cast("long").alias("words"), m[1].alias("evidence"), (1 / (1 + F.exp(-odds))).alias("score"))
    return out.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == 0).alias("held_out"), "words", "evidence", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
