"""Product codes of vectors, the nearest codebook entry looked up among those a grid cell leaves.

Each part of a vector lies in a coarse cell, a box of equal sides. For a cell the
least and the largest squared distance between its box and every entry are sums over
the components of small tables. An entry whose least distance exceeds the smallest
largest distance of all entries can be nearest to no point of the box; the others
are what the cell leaves. A task keeps this answer under the hash of the cell, so
that all later vectors of the cell reuse it, and computes exact distances to those
entries alone. Entries that only tie are kept: the lower index wins.

Learning runs round by round on Spark: tasks assign and add up, a grouping adds the
tasks' sums, and the codebooks (parts x entries, whatever the table) are all that
the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .vectors import matrix, usable, whole

#: Cells whose answer a task keeps per part position; above that it starts afresh. An answer takes a bit per entry.
MEMO_CELLS = 100_000
#: Pairs of a vector and an entry evaluated at once.
PAIRS = 1 << 18


class Grid:
    """One part position: its entries, and what each cell met so far leaves of them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        spread = np.sqrt(np.maximum(1.0, self.entries.astype(np.float64).var(axis=0).mean()))
        #: Cells about half as wide as the entries spread: as wide as the spread they leave nearly every entry, at half of it a third.
        self.shift = max(0, int(np.ceil(np.log2(spread))) - 1)
        self.memo: dict[bytes, np.ndarray] = {}

    def _bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of each cell's box to each entry."""
        near = np.zeros((len(cells), len(self.entries)), np.int64)
        far = np.zeros_like(near)
        for d in range(cells.shape[1]):
            steps, place = np.unique(cells[:, d], return_inverse=True)
            low = (steps << self.shift)[:, None]
            high = low + (1 << self.shift) - 1
            e = self.entries[None, :, d]
            out = np.maximum(np.maximum(low - e, e - high), 0)
            most = np.maximum(np.abs(e - low), np.abs(high - e))
            near += (out * out)[place]
            far += (most * most)[place]
        return near, far

    def left(self, cells: np.ndarray) -> np.ndarray:
        """True where an entry may be nearest to some point of the cell; a row per cell."""
        keys = [c.tobytes() for c in cells]
        fresh = [i for i, k in enumerate(keys) if k not in self.memo]
        if len(self.memo) + len(fresh) > MEMO_CELLS:
            self.memo.clear()
            fresh = list(range(len(keys)))
        for start in range(0, len(fresh), 1024):
            some = fresh[start:start + 1024]
            near, far = self._bounds(cells[some])
            keep = np.packbits(near <= far.min(axis=1, keepdims=True), axis=1)
            self.memo.update((keys[i], k) for i, k in zip(some, keep))
        return np.unpackbits(np.stack([self.memo[k] for k in keys]), axis=1, count=len(self.entries)).astype(bool)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance."""
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        step = max(1, PAIRS // len(self.entries))
        for start in range(0, len(parts), step):
            x = parts[start:start + step]
            cells, cell = np.unique(x >> self.shift, axis=0, return_inverse=True)
            left = self.left(cells)[cell.reshape(-1)]
            row, entry = np.nonzero(left)
            gap = x[row] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            first = np.searchsorted(row, np.arange(len(x)))
            least = np.minimum.reduceat(d, first)
            at = np.flatnonzero(d == least[row])  # entries rise within a row, so the first is the lowest
            at = at[np.unique(row[at], return_index=True)[1]]
            index[start:start + step], error[start:start + step] = entry[at], least
        return index, error


def _first_book(vectors: DataFrame, n_entries: int, n_parts: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids; ``n_entries`` rows reach the driver."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "q").limit(n_entries).collect()
    return list(np.stack(np.split(np.array([r.q for r in rows], np.int64), n_parts, axis=1))) if rows else []


def _sums(vectors: DataFrame, books: list[np.ndarray], n_parts: int, width: int) -> DataFrame:
    """Per part position and entry: how many parts were assigned to it, and their sums."""
    side = width // n_parts

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        n, total = np.zeros((n_parts, len(books[0])), np.int64), np.zeros((n_parts, len(books[0]), side), np.int64)
        for batch in batches:
            x = matrix(batch.column("q"), width, np.int64)
            for p, grid in enumerate(grids):
                mine = x[:, p * side:(p + 1) * side]
                index, _ = grid.nearest(mine)
                n[p] += np.bincount(index, minlength=n.shape[1])
                np.add.at(total[p], index, mine)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    parts = vectors.select("q").mapInArrow(add, "part int, entry int, n long, total array<long>")
    return parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(side)]).alias("total"))


def learn_codebooks(vectors: DataFrame, width: int, n_parts: int = 4, n_entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks of whole numbers, one per part position, from columns ``id`` and ``q``."""
    books = _first_book(vectors, n_entries, n_parts)
    for _ in range(rounds if books else 0):
        books = [b.copy() for b in books]
        for r in _sums(vectors, books, n_parts, width).collect():  # parts x entries rows, whatever the table
            books[r.part][r.entry] = np.array(r.total, np.int64) // r.n
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def vector_codes(items: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", carry: list[str] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """Each vector as one codebook index per part (``code``, an array) with its squared ``error``, and the codebooks.

    Components become ``floor(scale * x)``; a vector is cut into ``n_parts`` equal
    consecutive parts. Codebooks start from the vectors with the smallest ids (nulls
    last, then the vectors themselves; all vectors where there are fewer than
    ``n_entries``). Rows whose vector is null, empty or holds a null or non-finite
    component are dropped, as are vectors of another length than the table's longest,
    which no common codebook can code. A length that ``n_parts`` does not divide
    raises. Repeated rows each count and are each returned; a null id is returned as
    it is. An empty table gives no rows and no codebooks. Columns not named in
    ``carry`` are ignored. Squared distances have to fit 63 bits.
    """
    carry = carry or []
    kept = items.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("carried"), whole(F.col(vector_col), scale).alias("q"))
    kept = stored(kept, "vectors")
    width = kept.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    if width % n_parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {n_parts} equal parts")
    kept = kept.where(F.size("q") == width)
    books = learn_codebooks(kept, width, n_parts, n_entries, rounds)
    side = width // n_parts
    keep = ["id", "carried"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        for batch in batches:
            x = matrix(batch.column("q"), width, np.int64)
            found = [grid.nearest(x[:, p * side:(p + 1) * side]) for p, grid in enumerate(grids)]
            codes, error = np.stack([f[0] for f in found], axis=1).astype(np.int32), sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], [*keep, "code", "error"])

    kinds = {f.name: f.dataType for f in kept.schema.fields}
    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in keep) + ", code array<int>, error long"
    out = kept.mapInArrow(code, schema)
    return out.select(F.col("id").alias(id_col), *[F.col("carried")[c].alias(c) for c in carry], "code", "error"), books


def label_errors(coded: DataFrame, label_col: str = "label", salts: int = 16) -> DataFrame:
    """Adds ``label_error``, the error summed over the rows of an equal label, nulls together.

    A label may hold a third of the rows: its rows are spread over ``salts`` tasks, which all get its one sum.
    """
    sums = coded.groupBy(label_col).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("*"), F.lit(salts)).cast("int")).alias("c")
    s = sums.alias("s")
    return dealt.join(s, (F.col("c.salt") == F.col("s.salt")) & F.col(f"c.{label_col}").eqNullSafe(F.col(f"s.{label_col}"))).select("c.*", "s.label_error").drop("salt")
