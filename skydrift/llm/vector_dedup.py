"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every unit vector is projected on many random directions, and each projection is a
list sorted by value. Two vectors collide in a list where the second lies in the
window centred on the first. Vectors of cosine c have jointly normal projections of
correlation c, whatever the data, so the number of collisions of a pair is binomial,
and the count that a pair must reach is set from that: at least ``recall`` of the
pairs at the threshold reach it, and more of the closer ones. Pairs that reach it are
verified by their cosine in double precision.

Over a whole line a window holds a fixed share of all vectors, and counting would
compare everything with everything. Windows are therefore opened only in the thin
tails: a vector takes part in the lists where it is among the extremes, about
``windows`` of them. There the same binomial argument holds with the chance that both
vectors are in the tail and in one window, while vectors of no kinship rarely meet.
The number of lists grows with the square root of the table.

Equal vectors are one before all this. A list's tail is dealt in blocks of bounded
size, pairs of blocks meet in a task, and a pair is counted, verified and taken into
the sums in the first list where it collides; pairs never leave the task, only sums
per vector and a spanning forest of the links do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .vectors import flat, matrix, usable

#: Vectors projected at once, and block pairs' pairs verified at once.
ROWS, PAIRS = 1024, 1 << 17


def tail_start(share: float) -> float:
    """Where the tails begin that hold ``share`` of a normal distribution, both together."""
    low, high = 0.0, 40.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(middle / math.sqrt(2)) > share else (low, middle)
    return high


def collision_chance(cosine: float, tail: float, window: float) -> float:
    """That two unit vectors of this cosine lie in the same tail of a list and within one window."""
    t = np.linspace(tail, tail + 12, 24_001)
    s = math.sqrt(1 - cosine * cosine)
    below = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    inner = below((t + window - cosine * t) / s) - below((np.maximum(tail, t - window) - cosine * t) / s)
    y = np.exp(-t * t / 2) / math.sqrt(2 * math.pi) * inner
    return 2 * float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0]))


def required_count(lists: int, chance: float, recall: float) -> int:
    """The largest count that a pair colliding with this chance reaches with probability ``recall``; one at least."""
    below, term, k = 0.0, (1 - chance) ** lists, 0
    while below + term <= 1 - recall:
        below += term
        term *= (lists - k) / (k + 1) * chance / (1 - chance)
        k += 1
    return max(1, k)


def number_of_lists(n: int) -> int:
    """A power of two near 16 times the square root of the table's size; 512 at least."""
    return max(512, 2 ** round(math.log2(16 * math.sqrt(max(1, n)))))


def directions(width: int, lists: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, lists), dtype=np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tails(vectors: DataFrame, width: int, lists: int, tail: float, seed: int) -> DataFrame:
    """Adds ``at``, the list ends (two per list) where a vector is among the extremes, and ``t``, how far out it is there."""
    keep = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = directions(width, lists, seed)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                t = unit_rows(matrix(batch.column("v"), width)).astype(np.float32) @ lines
                row, line = np.nonzero(np.abs(t) >= tail)
                value = t[row, line]
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                at = pa.ListArray.from_arrays(ends, pa.array((2 * line + (value > 0)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), at, pa.ListArray.from_arrays(ends, pa.array(np.abs(value)))], [*keep, "at", "t"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, at array<int>, t array<float>")


def links_of(node: np.ndarray, copies: np.ndarray, x: np.ndarray, at: list[np.ndarray], t: list[np.ndarray], block: np.ndarray, here: int, cross: bool, window: float, need: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of one list end (as places) that collide there for the first time; pairs of two blocks only if ``cross``."""
    n = len(node)
    row = np.repeat(np.arange(n), [len(a) for a in at])
    lists, value = np.concatenate(at), np.concatenate(t)
    _, place, often = np.unique(lists, return_inverse=True, return_counts=True)
    shared = often[place] > 1
    row, lists, value = row[shared], lists[shared], value[shared]
    by = np.argsort(lists, kind="stable")
    row, lists, value = row[by], lists[by], value[by]
    count = np.zeros((n, n), np.int16)
    earlier = np.zeros((n, n), bool)
    mine = np.zeros((n, n), bool)
    cuts = np.flatnonzero(np.diff(lists)) + 1
    for i, v, l in zip(np.split(row, cuts), np.split(value, cuts), lists[np.r_[0, cuts]] if len(lists) else []):
        meet = np.abs(v[:, None] - v[None, :]) <= window
        spot = np.ix_(i, i)
        count[spot] += meet
        if l < here:
            earlier[spot] |= meet
        elif l == here:
            mine[spot] |= meet
    a, b = np.nonzero(np.triu(mine & ~earlier & (count >= need), 1))
    if cross:
        between = block[a] != block[b]
        a, b = a[between], b[between]
    good = [np.einsum("ij,ij->i", x[a[s:s + PAIRS]], x[b[s:s + PAIRS]]) >= threshold for s in range(0, len(a), PAIRS)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return a[good], b[good]


def forest(n: int, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each place the least node that its links reach."""
    label = node.copy()
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == label).all():
            return label
        label = new


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one key at a time, from batches sorted by the keys; groups have a bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            now = tuple(key[start])
            if now != last and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = now
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def linked(vectors: DataFrame, width: int, threshold: float, recall: float, windows: int, window: float, block_rows: int, seed: int) -> DataFrame:
    """``node``, ``n``, ``other``: parts of the number of vectors linked to a node, and a neighbour in a spanning forest. From ``node``, ``copies``, ``v``."""
    lists = number_of_lists(vectors.count())
    tail = tail_start(windows / lists)
    need = required_count(lists, collision_chance(threshold, tail, window), recall)
    placed = stored(tails(vectors, width, lists, tail, seed), "tails")  # kept: a task that runs anew must see the same windows
    entries = placed.withColumn("end", F.explode("at"))
    # two rows per list at most, whatever the table
    crowded = placed.select(F.explode("at").alias("end")).groupBy("end").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")).where("blocks > 1")
    entries = entries.join(F.broadcast(crowded), "end", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["end", "low", "high"]
    entries = entries.select("end", F.least("block", "beside").alias("low"), F.greatest("block", "beside").alias("high"), "block", "node", "copies", "v", "at", "t")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if group.num_rows < 2:
                continue
            node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
            x = unit_rows(matrix(group.column("v"), width))
            at, lengths = flat(group.column("at"))
            t, _ = flat(group.column("t"))
            cuts = np.cumsum(lengths)[:-1]
            here, cross = group.column("end")[0].as_py(), group.column("low")[0].as_py() != group.column("high")[0].as_py()
            a, b = links_of(node, copies, x, np.split(at, cuts), np.split(t, cuts), block, here, cross, window, need, threshold)
            if len(a):
                n = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
                has = np.flatnonzero(n)
                other = forest(len(node), a, b, node)
                yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(n[has].astype(np.int64)), pa.array(other[has])], ["node", "n", "other"])

    spread = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(spread, *keys).sortWithinPartitions(*keys).mapInArrow(meet, "node long, n long, other long")


def near_duplicate_vectors(items: DataFrame, threshold: float = 0.95, recall: float = 0.998, windows: int = 16, window: float = 0.8, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024, seed: int = 13) -> DataFrame:
    """One row per row of ``items``: its id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable by links) and ``kept`` (it is its own ``component_id``).

    Pairs with cosine of at least ``threshold`` are found with probability
    ``recall`` at the threshold and a higher one above it; no other pair is linked.
    Null, empty and all-zero vectors and such with a null or non-finite component link
    with nothing. Equal vectors are linked whatever the projections; rows that repeat
    an id and a vector count as two vectors. A shorter vector counts as filled
    with zeros. A null id links like any other but is never smallest; a row whose
    component holds no other id has itself as ``component_id``. An empty table gives
    none. Other columns are ignored.

    ``windows`` lists' tails hold a vector on average, ``window`` is half a
    window's width in standard deviations. ``block_rows`` bounds a task. A group of m
    different vectors that are all linked costs m x m products in blocks.
    """
    v = F.col(vector_col)
    good = usable(v) & F.exists(v, lambda x: x != 0)
    rows = items.select(F.col(id_col).alias("id"), F.when(good, v).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g"))))
    rows = stored(rows, "rows")
    unique = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    unique = stored(unique.withColumn("node", F.monotonically_increasing_id()), "unique")
    width = unique.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if not width:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(linked(unique.select("node", "copies", "v"), width, threshold, recall, windows, window, block_rows, seed), "links")
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = unique.select("key", "node", "copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "label").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
    known = known.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
