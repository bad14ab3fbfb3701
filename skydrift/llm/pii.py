"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The field labels whole segments of tokens: every candidate of up to ``SPAN`` tokens
around digits, at signs and equal signs gets features of the span as a whole
(digits, dots, checksum, mixture of letters and digits, words before it, whether
it cuts a longer word), and dynamic programming over segment ends chooses
boundaries and types jointly, in time linear in the text. Weights come from
gradient ascent on the likelihood (forward-backward over segments) of a bounded
sample, labelled by the patterns and by key formats.

Rows never meet; each text is read where it lies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

KINDS = ["email", "ip", "card", "phone", "secret"]
SPAN = 14
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile("[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|token|secret|api_key)\s*[=:]\s*\"?([A-Za-z0-9_-]{16,})")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, 0, end
        at = text.find("@", m.end() if m else at + 1)


def addresses(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts = run[0].split(".")
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)]) + run.start()
        i = 0
        while i + 3 < len(parts):
            if all(parts[i : i + 4]):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                    yield int(starts[i]), 1, int(starts[i + 3]) + len(parts[i + 3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind; ends are exclusive, places are code points."""
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += addresses(text)
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def known_spans(text: str) -> list[Span]:
    """What the field learns from: the patterns' spans and keys of known formats, without overlaps."""
    found = base_spans(text) + [(m.start(1) if m[1] else m.start(), 4, m.end()) for m in _KEY.finditer(text)]
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[0], -s[2])):
        if not out or s[0] >= out[-1][2]:
            out.append(s)
    return out


# --- candidates ------------------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@=]+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CUES = ("password", "passwd", "token", "secret", "key")


def islands(text: str, reach: int = 40) -> Iterator[tuple[int, int]]:
    """Stretches around digits, at signs and equal signs; all else is outside any span."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        if hi >= 0 and m.start() - reach <= hi:
            hi = m.end() + reach
        else:
            if hi >= 0:
                yield max(lo, 0), min(hi, len(text))
            lo, hi = m.start() - reach, m.end() + reach
    if hi >= 0:
        yield max(lo, 0), min(hi, len(text))


def describe(text: str, start: int, end: int, n: int) -> list[int]:
    """Numbers of the features that hold for the span as a whole."""
    s = text[start:end]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    f = [0, 1 + (digits > 0) + (digits > 4) + (digits > 8) + (digits > 11) + (digits > 15) + (digits > 19)]
    before, after = text[start - 1 : start], text[end : end + 1]
    head, tail = s[0], s[-1]
    parts = s.split(".")
    hold = (
        "@" in s and "." in s.partition("@")[2], "@" in s, len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts), len(parts) == 4 and all(map(str.isdigit, parts)),
        12 <= digits <= 19 and not letters and luhn("".join(c for c in s if c in "0123456789")), head == "+", head == "(", not head.isalnum() and head not in "+(", not tail.isalnum(),
        " " in s or "\n" in s, letters > 0, letters > 0 and digits > 0, letters > 0 and digits > 0 and n == 1 and len(s) >= 16, bool(_HEX.fullmatch(s)), n == 1 and len(s) >= 16 and digits > 0 and s.isupper(),
        any(c in s for c in "()-"), any(c in s for c in "=\":;,"), bool(before) and (before.isalnum() or before in "@+_"), bool(after) and (after.isalnum() or after in "@_"),
        before in (".", "-") and start > 1 and text[start - 2].isalnum(), after in (".", "-", "@") and text[end + 1 : end + 2].isalnum(),
        any(c in text[max(0, start - 14) : start].lower() for c in _CUES), n == 1, n > 3, digits == 0 and "@" not in s,
    )
    return f + [8 + i for i, h in enumerate(hold) if h]


FEATURES = 8 + 25
N = len(KINDS)


def segments(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Tokens, candidate segments (first, end exclusive) and their feature rows. A segment needs a digit or an at sign and no line break."""
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    found, rows = [], []
    hot = [any(c in "0123456789@" for c in text[a:b]) for a, b in tokens]
    for i in range(len(tokens)):
        seen = False
        for j in range(i, min(i + SPAN, len(tokens))):
            if j > i and (tokens[j][0] - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1] : tokens[j][0]]):
                break
            seen = seen or hot[j]
            if seen:
                found.append((i, j + 1))
                row = np.zeros(FEATURES)
                row[describe(text, tokens[i][0], tokens[j][1], j + 1 - i)] = 1
                rows.append(row)
    return tokens, found, np.array(rows).reshape(-1, FEATURES)


class SemiMarkov:
    """Weights of features per kind. One token outside any span scores nothing, so weights say how much better a span explains its tokens."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, N))

    def fit(self, cases: list[tuple[int, list[tuple[int, int]], np.ndarray, dict[tuple[int, int], int]]], rounds: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> SemiMarkov:
        """Adagrad on the log-likelihood; a case is its number of tokens, candidates, their rows, and the kinds of the true ones."""
        total = np.full_like(self.w, 1e-8)
        cases = [c for c in cases if c[1]]
        for _ in range(rounds):
            grad = -ridge * len(cases) * self.w
            for n, found, rows, gold in cases:
                scores = rows @ self.w
                expected = self.marginals(n, found, scores)
                truth = np.zeros_like(expected)
                for k, seg in enumerate(found):
                    if seg in gold:
                        truth[k, gold[seg]] = 1
                grad += rows.T @ (truth - expected)
            total += grad**2
            self.w += rate * grad / np.sqrt(total)
        return self

    @staticmethod
    def marginals(n: int, found: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        whole = np.logaddexp.reduce(scores, axis=1)
        ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(found):
            ending[j].append(k), starting[i].append(k)
        left, right = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            left[j] = np.logaddexp.reduce([left[j - 1], *(left[found[k][0]] + whole[k] for k in ending[j])])
        for i in range(n - 1, -1, -1):
            right[i] = np.logaddexp.reduce([right[i + 1], *(right[found[k][1]] + whole[k] for k in starting[i])])
        i, j = np.array(found).T
        return np.exp(left[i][:, None] + scores + right[j][:, None] - left[n])

    def best(self, n: int, found: list[tuple[int, int]], rows: np.ndarray) -> list[tuple[int, int, int]]:
        """The likeliest segmentation's spans: first token, end, kind."""
        if not found:
            return []
        scores = rows @ self.w
        kind, top = scores.argmax(axis=1), scores.max(axis=1)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(found):
            ending[j].append(k)
        best, came = np.zeros(n + 1), np.full(n + 1, -1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in ending[j]:
                if best[found[k][0]] + top[k] > best[j]:
                    best[j], came[j] = best[found[k][0]] + top[k], k
        out, j = [], n
        while j > 0:
            if came[j] < 0:
                j -= 1
            else:
                i, e = found[came[j]]
                out.append((i, e, int(kind[came[j]])))
                j = i
        return out[::-1]


def added_spans(text: str, base: list[Span], model: SemiMarkov) -> list[Span]:
    """The field's spans that touch none of the patterns'."""
    out, taken = [], np.zeros(0)
    if base:
        taken = np.array([(s, e) for s, _, e in base])
    for lo, hi in islands(text):
        tokens, found, rows = segments(text, lo, hi)
        for i, j, kind in model.best(len(tokens), found, rows):
            s, e = tokens[i][0], tokens[j - 1][1]
            if not (len(taken) and ((taken[:, 0] < e) & (s < taken[:, 1])).any()):
                out.append((s, kind, e))
    return out


def train(docs: DataFrame, max_docs: int) -> SemiMarkov | None:
    """Fits on ``max_docs`` texts at most, those of smallest hash among texts with a digit or an at sign."""
    picked = docs.where(F.col("text").rlike("[0-9@]")).select("id", F.xxhash64("text").alias("h")).orderBy("h", "id").limit(max_docs)
    d, p = docs.alias("d"), F.broadcast(picked).alias("p")  # max_docs ids at most
    texts = d.join(p, F.col("d.id").eqNullSafe(F.col("p.id")) & (F.xxhash64("d.text") == F.col("h")), "left_semi").select("text").dropDuplicates()

    def cases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [text.as_py()[max(0, lo - 20) : hi + 20] for text in b.column(0) for lo, hi in islands(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([c for c in cut if len(c) < 2000], pa.string())], ["stretch"])

    stretches = sorted(r[0] for r in stored(texts.mapInArrow(cases_of, "stretch string").distinct().orderBy(F.xxhash64("stretch")).limit(max_docs), "stretches").collect())
    cases = []
    for s in stretches:
        tokens, found, rows = segments(s, 0, len(s))
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}
        known = known_spans(s)
        if all(a in first and b in last for a, _, b in known):
            gold = {(first[a], last[b] + 1): k for a, k, b in known}
            if set(gold) <= set(found):
                cases.append((len(tokens), found, rows, gold))
    return SemiMarkov().fit(cases) if any(c[3] for c in cases) else None


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 600) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``added``, arrays of (kind, start, end) in code points, by start and then kind.

    ``base`` holds the patterns' spans and is exact; ``added`` the field's that do not
    touch them. Null and empty texts have none; rows that repeat are each read by
    themselves. A table without any pattern's span has nothing to learn from and
    gets no added ones.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = train(docs, max_docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            base, added = [], []
            for text in b.column("text").to_pylist():
                known = base_spans(text) if text else []
                more = added_spans(text, known, field) if text and field else []
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in known])
                added.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in more])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(base, pa.list_(kind)), pa.array(added, pa.list_(kind))], ["id", "base", "added"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, base {span}, added {span}").withColumnRenamed("id", id_col)
