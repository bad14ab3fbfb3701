"""Word sequences that occur more than once, removed wherever they occur.

1. Every window of ``length`` words names an anchor, the least of its k-gram hashes
   (the rightmost of equals): equal windows name equal anchors, and about one word
   in ten is one. Anchors are counted over the corpus.
2. Only windows whose anchor occurs twice can occur twice. Those are hashed whole
   (128 bits), counted, and the repeated ones go back to their documents.
3. Each document drops the words its repeated windows cover.

Counts combine before their shuffles, so a passage that a third of all documents
hold is one row per task; ways back are equi-joins that adaptive execution can
split. Copies of a whole text are one text from the start and lose all words.

Suffix automata of reference shards would have every document streamed past every
shard, which grows with the square of a corpus that is its own reference. That is an
estimate: they were not built, and there are no measured figures of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .near_dedup import WordHash, chunks, mixed

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_PLACES = np.uint64((1 << 20) - 1)


def joined_hashes(w: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Hashes of the ``k`` words from each place on, by doubling; the last ``k - 1`` places hold garbage."""
    def power(e: int) -> np.uint64:
        return np.uint64(pow(int(base), e, 1 << 64))

    def ahead(x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([x[n:], np.zeros(min(n, len(x)), np.uint64)])

    total, have, run, size = None, 0, w, 1
    while True:
        if k & size:
            total, have = (run, size) if total is None else (total * power(size) + ahead(run, have), have + size)
        if size * 2 > k:
            return mixed(total)
        run = run * power(size) + ahead(run, size)
        size *= 2


def least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on."""
    def both(a: np.ndarray, shift: int) -> np.ndarray:
        out = a.copy()
        if shift < len(a):
            np.minimum(out[:-shift], a[shift:], out=out[:-shift])
        return out

    size = 1
    while size * 2 <= n:
        x = both(x, size)
        size *= 2
    return both(x, n - size) if n > size else x


class Windows:
    """The full windows of a run of texts: the text of each, its first word there, and its anchor."""

    def __init__(self, group: list[list[bytes]], known: WordHash, length: int, k: int):
        counts = np.fromiter(map(len, group), np.int64, len(group))
        self.words = known.of([x for t in group for x in t])
        text = np.repeat(np.arange(len(group)), counts)
        starts = np.cumsum(counts) - counts
        at = np.arange(len(self.words))
        self.first = np.flatnonzero(at + length <= (starts + counts)[text]) if len(at) else at
        self.text, self.start = text[self.first], self.first - starts[text[self.first]]
        self.length = length
        if len(self.first):
            grams = joined_hashes(self.words, k, _BASES[0])
            least = np.full(len(grams), 0, np.uint64)
            for lo in range(0, len(grams), 1 << 19):  # places fit twenty bits
                part = grams[lo : lo + (1 << 19) + length]
                packed = (part & ~_PLACES) | (_PLACES - np.arange(len(part), dtype=np.uint64))
                place = lo + (_PLACES - (least_ahead(packed, length - k + 1) & _PLACES)).astype(np.int64)
                n = min(1 << 19, len(grams) - lo)
                least[lo : lo + n] = place[:n].astype(np.uint64)
            self.place = least[self.first].astype(np.int64)
            self.anchor = grams[self.place]
        else:
            self.place, self.anchor = self.first, self.words[:0]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        a = joined_hashes(self.words, self.length, _BASES[0])
        b = joined_hashes(mixed(self.words ^ _BASES[1]), self.length, _BASES[1])
        return a[self.first].astype(np.int64), b[self.first].astype(np.int64)


def marks_of(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per row: its words' number, 128-bit hash and SHA-256, and its anchors, those at two places or more of the text apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHash()
        for b in batches:
            node, n, sha, once, more = [], [], [], [], []
            for _, group in chunks(b.column("text").to_pylist()):
                win = Windows(group, known, length, k)
                cuts = np.searchsorted(win.text, np.arange(len(group) + 1))
                for i, w in enumerate(group):
                    whole = b" ".join(w)
                    node.append(xxhash.xxh128_digest(whole)), n.append(len(w)), sha.append(hashlib.sha256(whole).hexdigest())
                    place, at = np.unique(win.place[cuts[i] : cuts[i + 1]], return_index=True)
                    values, times = np.unique(win.anchor[cuts[i] : cuts[i + 1]][at].astype(np.int64), return_counts=True)
                    once.append(values[times == 1]), more.append(values[times > 1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sha), pa.array(once, longs), pa.array(more, longs)],
                                             ["id", "row", "node", "n_words", "sha", "once", "more"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, row long, node binary, n_words long, sha string, once array<long>, more array<long>"
    return docs.select("id", "row", "text").mapInArrow(run, schema).withColumn("no", F.monotonically_increasing_id())


def windows_of(texts: DataFrame, length: int, k: int) -> DataFrame:
    """``no``, ``start`` and the hash ``a``, ``b`` of the windows whose anchor is among the row's ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            no, wanted = batch.column("no").to_numpy(), batch.column("anchors").to_pylist()
            for first, group in chunks(batch.column("text").to_pylist()):
                win = Windows(group, known, length, k)
                if not len(win.first):
                    continue
                own = mixed(win.text.astype(np.uint64)) ^ win.anchor  # an anchor counts for its own text only
                lists = wanted[first : first + len(group)]
                repeated = np.array([x for t in lists for x in t], np.int64).astype(np.uint64) ^ mixed(np.repeat(np.arange(len(lists)), [len(t) for t in lists]).astype(np.uint64))
                use = np.isin(own, repeated)
                a, b = win.hashes()
                yield pa.RecordBatch.from_arrays([pa.array(no[first + win.text[use]]), pa.array(win.start[use].astype(np.int32)), pa.array(a[use]), pa.array(b[use])], ["no", "start", "a", "b"])

    return texts.select("no", "text", "anchors").mapInArrow(run, "no long, start int, a long, b long")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """``no``, the ``spans`` of words that repeated windows cover, how many they are, and the SHA-256 of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, removed, sha = [], [], []
            for text, starts in zip(b.column("text"), b.column("starts")):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                s = np.array(starts.as_py(), np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in turns.reshape(-1, 2)])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(~gone))).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("no"), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(sha)], ["no", "spans", "n_removed", "kept_sha256"])

    return texts.select("no", "text", "starts").mapInArrow(run, "no long, spans array<struct<start:bigint,end:bigint>>, n_removed long, kept_sha256 string")


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, k: int = 16) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_removed``, ``spans`` (removed, in words) and ``kept_sha256``.

    A word goes when a window of ``length`` words over it also starts anywhere else.
    Null, empty and blank texts have no words; texts shorter than a window keep all.
    Rows that repeat, with the same id or not, repeat each other's windows and lose
    all of them. No rows: no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = stored(marks_of(docs, length, k), "marks")
    nodes = marks.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("no").alias("no"))
    nodes = stored(nodes, "nodes")
    first = marks.where(F.size("once") + F.size("more") > 0).join(nodes.select("no"), "no", "left_semi")
    anchors = first.select("no", F.explode(F.concat(F.transform("once", lambda h: F.struct(h.alias("h"), F.lit(1).alias("n"))), F.transform("more", lambda h: F.struct(h.alias("h"), F.lit(2).alias("n"))))).alias("x")).select("no", "x.*")
    common = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    suspects = anchors.join(common, "h").groupBy("no").agg(F.collect_list("h").alias("anchors"))
    s = suspects.join(marks.select("no", "id", "row"), "no").alias("s")
    d = docs.where("text IS NOT NULL").alias("d")
    texts = d.join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.row") == F.col("s.row"))).select("no", "text", "anchors").dropDuplicates(["no"])
    texts = stored(texts, "texts")
    windows = stored(windows_of(texts, length, k), "windows")
    twice = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    starts = windows.join(twice, ["a", "b"]).groupBy("no").agg(F.collect_list("start").alias("starts"))
    covered = cut(texts.select("no", "text").join(starts, "no"), length)
    out = marks.drop("once", "more").join(nodes.select("node", "copies"), "node").join(covered, "no", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= length)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
