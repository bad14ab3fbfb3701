"""Texts scored by a causal self-attention model over subword ids, and by word counts.

1. Words of the training documents are counted, with a partial count per task.
   Subword counts follow from the distinct words.
2. The model is one attention layer in numpy. An id is predicted from the ids of
   its block and of the block before: windows overlap by one block, every id is
   scored in one of them, and a mask keeps out later ids and other texts. The
   output is a softmax over classes of ids and one within the class; the ids beyond
   the 4,096 most frequent are one class, with a softmax over its groups and one
   within the group. All are biased by the counts, so that training starts from the
   unigram model. Every id has its own input and output weights.
3. A bounded sample of training documents gives a common start. From it every task
   takes Adam steps on every block of its part of the training documents; the
   tasks' weights are averaged, weighted by tokens: part by part of the vector, so
   that no task holds more than one vector.
4. One pass scores all texts. A word's probability is that of its ids under the
   attention model, mixed with its share of the training tokens. Words that are frequent (at most 2^20 can be) are
   looked up in a broadcast table; all others meet the counts in a join, where no
   key can be hot because none is frequent.
"""

from __future__ import annotations

import base64
import copy
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .near_dedup import chunks
from .text import fold_of

BLOCK, DIM, CLASSES, PER_CLASS = 16, 16, 64, 64
HEAD = CLASSES * PER_CLASS
END = b" "  # no word is a space


def plain(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lowered."""
    return (text or "").encode().lower().split()


class Subwords(dict):
    """A word's ids in a public byte-level vocabulary, each word by itself after a space."""

    def __init__(self, path: str, pattern: str, limit: int = 500_000):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end, self.limit = max(ranks.values()) + 1, limit

    def __missing__(self, word: bytes) -> bytes:
        ids = np.asarray(self.encoding.encode_ordinary(" " + word.decode()), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.pieces(words)[0]

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The ids of the words and of the end, and how many each of these has."""
        if len(self) > self.limit:
            self.clear()
        parts = list(map(self.__getitem__, words))
        return np.append(np.frombuffer(b"".join(parts), "<u4"), self.end).astype(np.int64), [len(x) // 4 for x in parts] + [1]


def _times(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``a @ w`` as one product of two matrices."""
    return (a.reshape(-1, a.shape[-1]) @ w).reshape(*a.shape[:-1], w.shape[1])


class Attention:
    """One causal attention layer; ``p`` holds its weights, float32."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        smooth = counts + 0.5
        order = np.argsort(-smooth, kind="stable")
        self.place = np.empty(len(counts), np.int64)  # rank by count; ranks from HEAD on share one class of several groups
        self.place[order] = np.arange(len(counts))
        ranked = smooth[order]
        units = max(CLASSES + 1, -(-len(ranked) // PER_CLASS))  # classes, then groups of the last class
        each = np.append(ranked, np.full(units * PER_CLASS - len(ranked), 1e-9)).reshape(units, PER_CLASS)
        sums = each.sum(1)
        mass, tail = np.append(sums[:CLASSES], sums[CLASSES:].sum()), sums[CLASSES:]
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "e": n(units * PER_CLASS, DIM), "q": n(DIM, DIM), "k": n(DIM, DIM), "v": n(DIM, DIM), "o": n(DIM, DIM), "x": n(DIM, DIM) + np.eye(DIM, dtype=np.float32), "r": np.zeros(2 * BLOCK, np.float32),
            "u1": n(CLASSES + 1, DIM) * 0, "b1": np.log(mass / mass.sum()).astype(np.float32),
            "u3": n(len(tail), DIM) * 0, "b3": np.log(tail / tail.sum()).astype(np.float32),
            "u2": n(units, PER_CLASS, DIM) * 0, "b2": np.log(each / sums[:, None]).astype(np.float32),
        }

    def windows(self, ids: list[np.ndarray], use: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """Blocks of the texts in a row, all or those that ``use`` marks by number: inputs and text of two blocks, targets of the second, both as places."""
        flat = np.concatenate(ids)
        text = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        before = np.concatenate([[0], flat[:-1]])
        first = np.concatenate([[True], text[1:] != text[:-1]])
        before[first] = [x[-1] for x in ids]  # a text begins after an end
        spare = -len(flat) % BLOCK
        before = np.append(before, np.zeros(spare, np.int64)).reshape(-1, BLOCK)
        goal = np.append(flat, np.zeros(spare, np.int64)).reshape(-1, BLOCK)
        text = np.append(text, np.full(spare, -1)).reshape(-1, BLOCK)
        at = np.arange(len(goal))
        at = at[use(at)] if use else at
        two = lambda x: np.concatenate([x[at - 1], x[at]], axis=1)
        own = two(text)
        own[at == 0, :BLOCK] = -2
        return self.place[two(before)], own, self.place[goal[at]]

    _FAR = np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]

    def context(self, inputs: np.ndarray, own: np.ndarray) -> tuple:
        p = self.p
        x = p["e"][inputs]
        q, k, v = _times(x[:, BLOCK:], p["q"]), _times(x, p["k"]), _times(x, p["v"])
        bias = np.where(self._FAR >= 0, p["r"][np.maximum(self._FAR, 0)], np.float32(-1e9))
        raw = q @ k.transpose(0, 2, 1)
        raw *= np.float32(DIM**-0.5)
        raw += bias
        mixed = np.flatnonzero((own != own[:, -1:]).any(1))  # blocks of more than one text
        raw[mixed] = np.where(own[mixed, BLOCK:, None] == own[mixed, None, :], raw[mixed], np.float32(-1e9))
        with np.errstate(over="ignore"):
            s = np.exp(raw)
            sums = s @ np.ones(2 * BLOCK, s.dtype)
        if not self._tame(sums):
            s = np.exp(raw - raw.max(2, keepdims=True))
            sums = s.sum(2)
        s /= sums[..., None]
        c = s @ v
        h = _times(x[:, BLOCK:], p["x"])
        h += _times(c, p["o"])
        np.tanh(h, out=h)
        return x, q, k, v, s, c, h

    @staticmethod
    def _tame(sums: np.ndarray) -> bool:
        """Whether sums of exponentials are so near to 1 that no maximum has to be taken off; also of none."""
        return not sums.size or bool(1e-25 < sums.min() and sums.max() < 1e25)

    def _level(self, h: np.ndarray, u: np.ndarray, b: np.ndarray, own: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """One softmax over ``h @ u.T + b``: the logarithms of the targets ``own``; the gradients of their sum by ``u`` and ``b`` are added to ``grads``, that by ``h`` is returned."""
        rows = np.arange(len(h))
        raw = h @ u.T
        raw += b
        chosen = raw[rows, own]
        with np.errstate(over="ignore"):
            z = np.exp(raw)
            sums = z @ np.ones(len(b), z.dtype)
        if not self._tame(sums):
            top = raw.max(1, keepdims=True)
            z = np.exp(raw - top)
            sums = z.sum(1)
            chosen = chosen - top[:, 0]
        out = chosen - np.log(sums)
        if grads is None:
            return out, None
        z /= -sums[:, None]
        z[rows, own] += 1
        grads[0][...] += z.T @ h
        grads[1][...] += np.ones(len(h), z.dtype) @ z
        return out, z @ u

    def outputs(self, h: np.ndarray, goal: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the targets' probabilities; the gradient of their sum by ``h`` where weights are learnt."""
        p = self.p
        unit = goal // PER_CLASS
        group = np.minimum(unit, CLASSES)
        pair = lambda u, b: None if grads is None else (grads[u], grads[b])
        parts = [self._level(h[lo : lo + 1024], p["u1"], p["b1"], group[lo : lo + 1024], pair("u1", "b1")) for lo in range(0, len(h), 1024)]
        out = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, h.dtype)
        dh = np.concatenate([d for _, d in parts]) if parts and grads is not None else np.zeros_like(h)
        at = np.flatnonzero(group == CLASSES)
        if len(at):
            logs, d = self._level(h[at], p["u3"], p["b3"], unit[at] - CLASSES, pair("u3", "b3"))
            out[at] += logs
            if grads is not None:
                dh[at] += d
        order = np.argsort(unit.astype(np.int16), kind="stable")
        ordered = unit[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
        present, ends = ordered[starts], np.append(starts[1:], len(order))
        if grads is not None:
            grads["u2"], grads["b2"] = ((present, np.zeros((len(present), *p[k].shape[1:]), p[k].dtype)) for k in ("u2", "b2"))
        by_unit, place, logs, d = h[order], (goal - unit * PER_CLASS)[order], np.empty(len(h), out.dtype), np.empty_like(h)
        for i, (c, lo, hi) in enumerate(zip(present, starts, ends)):
            part = slice(lo, hi)
            logs[part], more = self._level(by_unit[part], p["u2"][c], p["b2"][c], place[part], None if grads is None else (grads["u2"][1][i], grads["b2"][1][i]))
            if grads is not None:
                d[part] = more
        out[order] += logs
        if grads is not None:
            dh[order] += d
        return out, dh

    def tables(self) -> dict:
        """What scoring needs of the weights: queries, keys, values and direct parts of every place, and outputs with their biases as a last column."""
        p, one = self.p, np.ones((len(self.p["e"]), 1), self.p["e"].dtype)
        bound = lambda u, b: float((np.abs(u).sum(-1) + np.abs(b)).max())  # noqa: E731  |tanh| is at most 1
        q, k = p["e"] @ p["q"] * np.float32(DIM**-0.5), p["e"] @ p["k"]
        far = np.where(self._FAR >= 0, p["r"][np.maximum(self._FAR, 0)], np.float32(-np.inf))
        return {
            "q": q, "k": k, "v": np.concatenate([p["e"] @ p["v"], one], 1), "x": p["e"] @ p["x"], "far": far,
            "u1": np.ascontiguousarray(np.concatenate([p["u1"], p["b1"][:, None]], 1).T), "u2": np.ascontiguousarray(np.concatenate([p["u2"], p["b2"][..., None]], 2).transpose(0, 2, 1)), "u3": np.ascontiguousarray(np.concatenate([p["u3"], p["b3"][:, None]], 1).T),
            "plain": max(bound(p["u1"], p["b1"]), bound(p["u2"], p["b2"]), bound(p["u3"], p["b3"]), float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(p["r"]).max())) < 60,
        }

    def log_probabilities(self, ids: list[np.ndarray], tables: dict | None = None) -> np.ndarray:
        """The natural logarithm of every id's probability, texts in a row.

        The same as :meth:`context` and :meth:`outputs`, from tables by place. Where
        the weights bound all exponents (``plain``), they need no maximum taken off.
        """
        t = tables or self.tables()
        inputs, own, goal = self.windows(ids)
        if not t["plain"]:
            logs = [self.outputs(self.context(inputs[lo : lo + 256], own[lo : lo + 256])[-1].reshape(-1, DIM), goal[lo : lo + 256].reshape(-1))[0] for lo in range(0, len(goal), 256)]
            return np.concatenate(logs)[: sum(map(len, ids))]
        mixed = (own != own[:, -1:]).any(1)
        h = np.ones((len(goal), BLOCK, DIM + 1), t["x"].dtype)
        for lo in range(0, len(goal), 128):
            i, o, m = inputs[lo : lo + 128], own[lo : lo + 128], np.flatnonzero(mixed[lo : lo + 128])
            s = t["q"][i[:, BLOCK:]] @ t["k"][i].transpose(0, 2, 1)
            s += t["far"]
            np.exp(s, out=s)
            s[m] *= o[m, BLOCK:, None] == o[m, None, :]
            c = s @ t["v"][i]
            a = (c[..., :DIM] / c[..., DIM:]).reshape(-1, DIM) @ self.p["o"]
            a += t["x"][i[:, BLOCK:].reshape(-1)]
            np.tanh(a.reshape(-1, BLOCK, DIM), out=h[lo : lo + 128, :, :DIM])
        h, goal, ones = h.reshape(-1, DIM + 1), goal.reshape(-1), np.ones(max(CLASSES + 1, PER_CLASS, len(self.p["b3"])), h.dtype)  # a product with ones sums rows faster
        unit = (goal // PER_CLASS).astype(np.int16)
        out = np.empty(len(h), h.dtype)
        group = np.minimum(unit, CLASSES)
        for lo in range(0, len(h), 2048):
            z = h[lo : lo + 2048] @ t["u1"]
            out[lo : lo + 2048] = z[np.arange(len(z)), group[lo : lo + 2048]]
            np.exp(z, out=z)
            out[lo : lo + 2048] -= np.log(z @ ones[: z.shape[1]])
        tail = np.flatnonzero(group == CLASSES)
        for lo in range(0, len(tail), 2048):
            at = tail[lo : lo + 2048]
            z = h[at] @ t["u3"]
            own_z = z[np.arange(len(at)), unit[at] - CLASSES]
            np.exp(z, out=z)
            out[at] += own_z - np.log(z @ ones[: z.shape[1]])
        order = np.argsort(unit, kind="stable")
        present, starts = np.unique(unit[order], return_index=True)
        for c, same in zip(present, np.split(order, starts[1:])):
            for lo in range(0, len(same), 2048):
                at = same[lo : lo + 2048]
                z = h[at] @ t["u2"][c]
                own_z = z[np.arange(len(at)), goal[at] - int(c) * PER_CLASS]
                np.exp(z, out=z)
                out[at] += own_z - np.log(z @ ones[: z.shape[1]])
        return out[: sum(map(len, ids))]

    def gradient(self, inputs: np.ndarray, own: np.ndarray, goal: np.ndarray) -> tuple[dict, float, int]:
        """Gradients; those of ``e``, ``u2`` and ``b2`` are pairs of the rows in use and their values, as all others are zero."""
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("e", "u2", "b2")}
        x, q, k, v, s, c, h = self.context(inputs, own)
        real = own[:, BLOCK:].reshape(-1) >= 0
        flat = h.reshape(-1, DIM)
        logs, dflat = self.outputs(flat[real], goal.reshape(-1)[real], g)
        dh = np.zeros_like(flat)
        dh[real] = dflat
        da = (dh * (1 - flat**2)).reshape(h.shape)
        xq = x[:, BLOCK:]
        two = lambda a, b: a.reshape(-1, DIM).T @ b.reshape(-1, DIM)
        g["x"], g["o"] = two(xq, da), two(c, da)
        dxq, dc = _times(da, p["x"].T), _times(da, p["o"].T)
        ds = dc @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ dc
        ds *= s
        ds -= s * (ds @ np.ones(2 * BLOCK, ds.dtype))[..., None]
        g["r"] = np.bincount(np.maximum(self._FAR, 0).reshape(-1), weights=(ds.sum(0) * (self._FAR >= 0)).reshape(-1), minlength=2 * BLOCK).astype(np.float32)
        ds *= np.float32(DIM**-0.5)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g["q"], g["k"], g["v"] = two(xq, dq), two(x, dk), two(x, dv)
        dx = _times(dk, p["k"].T)
        dx += _times(dv, p["v"].T)
        dx[:, BLOCK:] += dxq + _times(dq, p["q"].T)
        at = np.argsort(inputs.astype(np.uint16) if len(p["e"]) <= 1 << 16 else inputs, axis=None, kind="stable")  # short numbers sort faster
        place = inputs.reshape(-1)[at]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        g["e"] = place[starts], np.add.reduceat(dx.reshape(-1, DIM)[at], starts)
        return g, float(logs.sum()), int(real.sum())

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)]).astype(np.float64)

    def load(self, vector: np.ndarray) -> Attention:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = vector[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self


class Adam:
    """Adam steps; rows of a weight that a batch does not use stay as they are, with their moments."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def step(self, inputs: np.ndarray, own: np.ndarray, goal: np.ndarray) -> int:
        g, _, n = self.model.gradient(inputs, own, goal)
        self.t += 1
        for k, x in self.model.p.items():
            at, d = g[k] if isinstance(g[k], tuple) else (slice(None), g[k])
            d = d / max(n, 1)
            m, v = self.m[k][at], self.v[k][at]
            m, v = m + 0.1 * (d - m), v + 0.01 * (d * d - v)
            self.m[k][at], self.v[k][at] = m, v
            x[at] += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)
        return n


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``c``; the end of texts is a word of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for b in batches:
            for text in b.column("text"):
                seen.update(plain(text.as_py()))
            seen[END] += b.num_rows
            if len(seen) > 1_000_000:
                yield rows()
                seen = Counter()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_subwords(words: DataFrame, vocabulary: tuple[str, str]) -> np.ndarray:
    """Counts of all ids of the vocabulary, from the words' counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Subwords(*vocabulary)
        total = np.zeros(known.end + 1)
        for b in batches:
            spelled, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            ids, sizes = known.pieces([w for w in spelled if w != END])
            is_end = np.array([w == END for w in spelled], bool)
            total += np.bincount(ids[:-1], np.repeat(c[~is_end], sizes[:-1]), len(total))
            total[known.end] += c[is_end].sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "c"])

    rows = words.mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()  # as many as the vocabulary at most
    out = np.zeros(Subwords(*vocabulary).end + 1)
    for r in rows:
        out[r["id"]] = r["c"]
    return out


PART = 1_024


def add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``weights``, float64, and of ``n`` per part number ``no``; holds one vector at most, however many tasks it is from."""
    sums: dict[int, list] = {}
    for b in batches:
        for no, weights, n in zip(b.column("no").to_pylist(), b.column("weights"), b.column("n").to_pylist()):
            values = np.frombuffer(weights.as_buffer())
            own = sums.setdefault(no, [np.zeros(len(values)), 0])
            own[0] += values
            own[1] += n
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["no", "weights", "n"])


def steps(docs: DataFrame, start: Attention, vocabulary: tuple[str, str], rate: float) -> Attention:
    """Every task's Adam steps from ``start`` on all blocks of its own documents, averaged."""
    sent = docs.sparkSession.sparkContext.broadcast(start)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Subwords(*vocabulary), 0
        model = copy.copy(sent.value)
        model.p = {k: v.copy() for k, v in sent.value.p.items()}
        adam = Adam(model, rate)
        for b in batches:
            for _, group in chunks(b.column("text").to_pylist(), 50_000):
                inputs, own, goal = model.windows([known.of([x.lower() for x in w]) for w in group])
                for lo in range(0, len(goal), 256):
                    total += adam.step(inputs[lo : lo + 256], own[lo : lo + 256], goal[lo : lo + 256])
        if total:
            whole = model.vector() * total
            for no in range(0, -(-len(whole) // PART), 64):
                some = [whole[i * PART : (i + 1) * PART] for i in range(no, min(no + 64, -(-len(whole) // PART)))]
                yield pa.RecordBatch.from_arrays([pa.array(range(no, no + len(some)), pa.int32()), pa.array([x.tobytes() for x in some], pa.binary()), pa.array([total] * len(some), pa.int64())], ["no", "weights", "n"])

    fitted = docs.select("text").mapInArrow(fit, "no int, weights binary, n long")
    rows = fitted.repartition("no").mapInArrow(add_parts, fitted.schema).collect()  # a few rows of each part of one vector
    if not rows:
        return start
    sums: dict[int, list] = {}
    for no, weights, n in rows:
        own = sums.setdefault(no, [np.zeros(len(weights) // 8), 0])
        own[0] += np.frombuffer(weights)
        own[1] += n
    out = copy.copy(start)
    out.p = dict(start.p)
    return out.load(np.concatenate([sums[no][0] / sums[no][1] for no in sorted(sums)]))


def train(docs: DataFrame, flat: Attention, vocabulary: tuple[str, str], start_docs: int, rate: float) -> Attention:
    """A start from the ``start_docs`` documents of smallest hash, in one task, then steps over all documents."""
    picked = docs.select("id", F.xxhash64("text").alias("h")).orderBy("h", "id").limit(start_docs).distinct()
    d, p = docs.alias("d"), F.broadcast(picked).alias("p")  # start_docs ids at most
    sample = d.join(p, F.col("d.id").eqNullSafe(F.col("p.id")) & F.xxhash64("d.text").eqNullSafe(F.col("h")), "left_semi").select("text").dropDuplicates()
    start = steps(stored(sample, "start").coalesce(1), flat, vocabulary, 3 * rate)
    return steps(docs, start, vocabulary, rate)


def lm_scores(docs: DataFrame, vocabulary: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1, start_docs: int = 1_000,
              rate: float = 0.004, share: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, both in log10.

    ``vocabulary`` is a file of byte-level ranks and its split pattern; ``share`` is the
    weight of the word counts in the mixture. Null text is an empty one: an end and
    nothing else. Rows that repeat count and score each for itself. Without training
    rows the counts are zero and the model is flat.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = docs.where(fold_of(F.col("id")) != held_out_fold)
    words = stored(count_words(training), "words").where("c > 0")
    size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    v, n = int(size[0]), int(size[1])
    often = {bytes(r[0]): r[1] for r in words.where(F.col("c") * (1 << 20) >= n).collect()}  # 2^20 at most, as their counts add up to n
    model = train(training, Attention(count_subwords(words, vocabulary)), vocabulary, start_docs, rate)
    sent = docs.sparkSession.sparkContext.broadcast((model, often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, common = sent.value
        tables = own.tables()
        known = Subwords(*vocabulary)
        for b in batches:
            tokens, logs, scores, rare, rare_logs = [], [], [], [], []
            for _, group in chunks(b.column("text").to_pylist(), 50_000):
                group = [[x.lower() for x in w] for w in group]
                ids, sizes = zip(*(known.pieces(w) for w in group))
                starts = np.concatenate([[0], np.cumsum([x for part in sizes for x in part])[:-1]])
                spelled = np.add.reduceat(own.log_probabilities(list(ids), tables), starts, dtype=float)
                count = np.array([common.get(x, 0) for w in group for x in (*w, END)], float)
                once = np.maximum(count, 0.5)
                base = np.where(count > 0, np.log10(once + 0.5), 0.0)
                both = np.where(count > 0, np.log10(share * once / max(n, 1) + (1 - share) * np.exp(spelled)), 0.0)
                at = 0
                for w in group:
                    part = slice(at, at + len(w) + 1)
                    other = np.flatnonzero(count[part] == 0)
                    tokens.append(len(w) + 1), logs.append(float(base[part].sum())), scores.append(float(both[part].sum()))
                    w.append(END)
                    rare.append([w[i] for i in other]), rare_logs.append(spelled[part][other].astype(np.float32))
                    at += len(w)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tokens, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_logs, pa.list_(pa.float32()))],
                                             ["id", "n_tokens", "logs", "score", "rare", "spelled"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, logs double, score double, rare array<binary>, spelled array<float>"
    scored = stored(docs.mapInArrow(score, schema).withColumn("no", F.monotonically_increasing_id()), "scored")
    apart = scored.select("no", F.explode(F.arrays_zip("rare", "spelled")).alias("x")).select("no", F.col("x.rare").alias("word"), "x.spelled")
    known, c = apart.join(words, "word", "left"), F.coalesce("c", F.lit(0))
    sums = known.groupBy("no").agg(
        F.sum(F.log10(c + 0.5)).alias("rare_logs"), F.count_if(F.col("c") > 0).alias("rare_known"),
        F.sum(F.when(F.col("c") > 0, F.log10(share * F.col("c") / max(n, 1) + (1 - share) * F.exp(F.col("spelled").cast("double")))).otherwise(F.col("spelled") / float(np.log(10)) + float(np.log10(1 - share)))).alias("rare_score"))
    out = scored.select("no", "id", "n_tokens", "logs", "score", F.size("rare").alias("n_rare")).join(sums, "no", "left")
    return out.select(
        F.col("id").alias(id_col), (fold_of(F.col("id")) == held_out_fold).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
