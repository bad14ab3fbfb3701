"""Packing of tokenised documents into sequences, as a cutting-stock problem.

1. Each text is tokenised where it lies and cut into pieces of the full sequence
   length and one rest. Only the pieces' numbers (start, length, checksum) leave
   the task; token ids do so when asked for.
2. The pieces' lengths, in steps of ``step`` tokens rounded up, make a histogram
   of at most ``capacity / step`` entries whatever the size of the input. On it the
   driver solves the linear program of cutting stock by column generation: the
   master's duals price patterns, an unbounded knapsack by dynamic programming
   finds the best new one. Pattern counts are rounded down and what is left over,
   less than one pattern per class, is packed by first fit.
3. Every piece gets its rank within its length class (counts per hash bucket and
   class first, so no class has to meet in one task), the rank names a slot in a
   pattern's copy, and the offset is a running sum within the one sequence.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

PIECES = "id {id}, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """The ids of white-space words, as little-endian 32-bit bytes.

    White space ends a token in this vocabulary, so a text's ids are those of its
    words in a row. Holds about ``limit`` words; beyond that it keeps those that came again.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.again = Tokenizer.from_file(path), limit, set()

    def learn(self, words: set[bytes]) -> None:
        """Tokenises what is not known yet, in one call.

        A full stop or comma after a letter is a token by itself, and case is folded
        but in special tokens: both make more words alike.
        """
        unknown, split = {w for w in words if w not in self}, {}
        self.again.update(words - unknown)
        for w in unknown:
            plain = w if b"<|" in w else w.lower()
            split[w] = (plain[:-1], plain[-1:]) if plain[-1:] in (b".", b",") and plain[-2:-1].isalpha() else (plain,)
        new = [x for x in {x for parts in split.values() for x in parts} if x not in self]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)]
        flat, at = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0
        for x, e in zip(new, ids):
            self[x] = flat[at : at + 4 * len(e)]
            at += 4 * len(e)
        for w, parts in split.items():
            self[w] = b"".join(map(self.__getitem__, parts))

    def forget(self) -> None:
        """Keeps the words that came again, unless they fill half of the space themselves."""
        kept = {w: self[w] for w in self.again} if 2 * len(self.again) < self.limit else {}
        self.clear()
        self.update(kept)
        self.again = set()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        if len(self) > self.limit:
            self.forget()
        self.learn({w for words in split for w in words})
        return [b"".join(map(self.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks that a worker runs: words that a task has met are known to the next."""
    return WordIds(path)


def tokenise(docs: DataFrame, path: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for b in batches:
            at, start, length, crc, total, parts = [], [], [], [], [], []
            texts = b.column(1).to_pylist()
            for i, ids in enumerate(x + end for lo in range(0, len(texts), 64) for x in known.encode(texts[lo : lo + 64])):
                for s in range(0, len(ids), width):
                    part = ids[s : s + width]
                    at.append(i), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(len(ids) // 4)
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = PIECES.format(id=docs.schema["id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(cut, schema)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable filling of ``capacity``, items without limit (dynamic programming)."""
    use = np.flatnonzero(worth > 1e-12)
    count = np.zeros(len(sizes), np.int64)
    if not len(use):
        return count
    s, v = sizes[use], worth[use]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(s)
    s, v, use = s[order], v[order], use[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c], pick[c] = best[c - 1], -1
        if n:
            gain = best[c - s[:n]] + v[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-15:
                best[c], pick[c] = gain[k], k
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[use[pick[c]]] += 1
            c -= s[pick[c]]
    return count


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces per size) and how often each is cut; together they hold all of ``demand``.

    A revised simplex over the patterns found so far. It may stop early after
    20 rounds per size: any basis is a whole packing, only less tight.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for turn in range(20 * m):
        duals = cost @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # one piece fewer of this size in a pattern saves
            column, price = -np.eye(m)[low], 0.0
        else:
            column, price = best_pattern(sizes, duals, capacity).astype(float), 1.0
            if duals @ column <= 1 + 1e-9:
                break
        step = inverse @ column
        ratios = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        basis[:, out], cost[out] = column, price
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
    plan = [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-7))) for j in range(m) if cost[j] and x[j] >= 1 - 1e-7]
    left = np.maximum(demand - sum((a * n for a, n in plan), np.zeros(m, np.int64)), 0).astype(np.int64)
    while left.any():  # fewer than one pattern per basis column: first fit, largest first
        room, a = capacity, np.zeros(m, np.int64)
        for i in np.argsort(-sizes):
            a[i] = min(left[i], room // sizes[i])
            room -= a[i] * sizes[i]
        n = max(1, int((left[a > 0] // a[a > 0]).min()))
        plan.append((a, n))
        left -= a * n
    return plan


def slots(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per size: the first rank of each run of slots, its pattern's first sequence, its slots per sequence and its place there."""
    base, runs = 0, {int(s): ([], [], [], []) for s in sizes}
    nexts = dict.fromkeys(runs, 0)
    for a, n in plan:
        for place, i in enumerate(np.flatnonzero(a)):
            s = int(sizes[i])
            for to, v in zip(runs[s], (nexts[s], base, int(a[i]), place)):
                to.append(v)
            nexts[s] += int(a[i]) * n
        base += n
    return {s: tuple(np.asarray(v, np.int64) for v in r) for s, r in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, step: int = 16, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, on request, its ``ids``.

    Null text is an empty one: a single end token. Rows that repeat an id or a
    text are packed each by itself; a null id is kept. No rows: no rows. A
    sequence holds at most ``capacity`` tokens, without a gap from offset 0.
    """
    spark = docs.sparkSession
    pieces = stored(tokenise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer_path, end_id, capacity, with_ids), "pieces")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / step).cast("int"))
    seen = sorted(pieces.groupBy("size").count().collect())  # capacity / step rows at most
    sizes, demand = np.asarray([r[0] for r in seen], np.int64), np.asarray([r[1] for r in seen], np.int64)
    runs = slots(sizes, cutting_stock(sizes, demand, capacity // step)) if seen else {}

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    firsts = pieces.groupBy("size", "bucket").count().select(  # one row per bucket and size
        F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), (F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")).alias("first"))
    placed = pieces.join(firsts, (F.col("size") == F.col("f_size")) & (F.col("bucket") == F.col("f_bucket"))).withColumn(
        "rank", F.col("first") + F.row_number().over(Window.partitionBy("bucket", "size").orderBy("id", "start", "ids_crc32")) - 1).drop("first", "bucket", "f_size", "f_bucket")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            sequence, seat_no = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                begin, base, each, place = runs[int(s)]
                j = np.searchsorted(begin, rank[own], side="right") - 1
                nth = rank[own] - begin[j]
                sequence[own], seat_no[own] = base[j] + nth // each[j], place[j] * capacity + nth % each[j]
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names) if n not in ("size", "rank")), pa.array(sequence), pa.array(seat_no)],
                                             [*(n for n in b.schema.names if n not in ("size", "rank")), "sequence_id", "seat"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name not in ("size", "rank")]
    seated = placed.mapInArrow(seat, ", ".join([*kept, "sequence_id long", "seat long"]))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1))  # at most capacity rows
    return seated.withColumn("offset", F.coalesce(before, F.lit(0).cast("long"))).drop("seat").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of every sequence, from ``pack(..., with_ids=True)``: ``sequence_id``, ``ids`` (at most the capacity)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
