"""Hard negatives by the threshold algorithm over sorted candidate lists of every dimension.

The rows are dealt into blocks and the anchors into groups; a task holds one block
and one group. There every dimension has its list of the block's rows, sorted by
component. An anchor reads the lists of its dimensions side by side, from the top
where its own component is positive and from the bottom where it is negative
(sorted access), and scores each row it meets for the first time by the whole inner
product of integers (random access). No row still unseen can score above the
threshold, the sum of the anchor's components times the values read last. Reading
ends once the threshold is strictly below the score that a row must have to count
in any of the anchor's windows: the k-th best seen in the window, or the window's
lower end while fewer than k have been seen. Strictly, since a tie may go to a
smaller id. What the blocks return, at most k rows for each window, meets in one
ranking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .vectors import usable, whole

#: Rows read from each list before the threshold is looked at for the first time; four times as many each time after.
FIRST_DEPTH = 16


class Lists:
    """Some rows with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        self.ids, self.rows, self.values = ids, rows, values
        self.order = np.argsort(values, axis=0, kind="stable")

    def seen(self, anchor: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, float], bool]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the rows that the anchor met until ``enough(places, scores, threshold)``."""
        n = len(self.ids)
        used = np.flatnonzero(anchor) if anchor.any() else np.arange(1)
        signed, up = anchor[used], anchor[used] >= 0
        met, scores = np.zeros(n, bool), np.zeros(n, self.values.dtype)
        done, depth = 0, min(n, FIRST_DEPTH)
        while True:
            fresh = np.zeros(n, bool)
            fresh[self.order[n - depth:n - done][:, used[up]]] = True
            fresh[self.order[done:depth][:, used[~up]]] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            scores[new] = self.values[new] @ anchor
            places = np.flatnonzero(met)
            if len(places) == n:
                return places, scores
            last = self.order[np.where(up, n - depth, depth - 1), used]
            if enough(places, scores[places], float(signed @ self.values[last, used])):
                return places, scores[places]
            done, depth = depth, min(n, depth * 4)


def best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]
    return np.lexsort((rows, ids, -scores))


def top(lists: Lists, anchor: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows but the anchor's own."""

    def enough(places: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
        scores = scores[lists.rows[places] != own]
        return len(scores) >= k and threshold < np.partition(scores, len(scores) - k)[len(scores) - k]

    places, scores = lists.seen(anchor, enough)
    others = lists.rows[places] != own
    places, scores = places[others], scores[others]
    found = best(lists.ids[places], lists.rows[places], scores, k)
    return places[found], scores[found]


def inside(scores: np.ndarray, positive: int, low: int, high: int) -> np.ndarray:
    return (low * positive <= 100 * scores.astype(np.int64)) & (100 * scores.astype(np.int64) <= high * positive)


def top_in_windows(lists: Lists, allowed: np.ndarray, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each positive score the places and scores of the k best allowed rows within its window."""

    def enough(places: np.ndarray, scores: np.ndarray, threshold: float) -> bool:
        if 100 * threshold >= high * min(positives):  # the k-th score of that window cannot be above its upper end
            return False
        mine = scores[allowed[places]]
        for p in positives:
            held = mine[inside(mine, p, low, high)]
            if len(held) >= k:
                if threshold >= np.partition(held, len(held) - k)[len(held) - k]:
                    return False
            elif 100 * threshold >= low * p:
                return False
        return True

    places, scores = lists.seen(anchor, enough)
    free = allowed[places]
    places, scores = places[free], scores[free]
    out = {}
    for p in positives:
        held = np.flatnonzero(inside(scores, p, low, high))
        held = held[best(lists.ids[places[held]], lists.rows[places[held]], scores[held], k)]
        out[p] = places[held], scores[held]
    return out


def as_matrix(column: pd.Series, width: int) -> np.ndarray:
    """Whole components, shorter vectors filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def narrow(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables in the fastest type whose inner products are exact."""
    most = max([1, *(int(np.abs(t).max()) for t in tables if t.size)])
    room = most * most * max(t.shape[1] for t in tables)
    kind = np.float32 if room < 2**24 else np.float64 if room < 2**53 else np.int64
    return [t.astype(kind) for t in tables]



def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int):
    """Every block of rows beside every group of anchors, as a pair of grouped tables."""
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(dealt(blocks).alias("block"), all_of(groups).alias("part"), F.col("row"), F.col("id"), F.col("label"), F.col("q"))
    right = anchors.select(all_of(blocks).alias("block"), dealt(groups).alias("part"), *[F.col(c).alias(c) for c in anchors.columns])
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))


def hard_negatives(items: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int = 8192, group_anchors: int = 1024) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels that score ``low`` to ``high`` percent as much.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. Scores are inner products of
    ``floor(scale * x)``; higher first, ties by smaller id. ``is_anchor`` is a
    condition on columns of ``items``; the label may be derived before the call.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Rows that are equal in all three count once; rows that share an id
    and nothing else are rows of their own. Shorter vectors count as filled with
    zeros. A window without rows gives no row; an empty table gives none. Columns
    other than the three are ignored.

    ``block_rows`` and ``group_anchors`` bound a task; they do not change the result.
    """
    spark = items.sparkSession
    rows = (items.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vector_col), scale).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    # stored once: the row numbers that tell rows apart must not change between jobs
    rows = stored(rows.groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor")).withColumn("row", F.monotonically_increasing_id()), "rows")
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    anchors = rows.where("anchor").select("row", "id", "label", "q")
    grid = max(1, -(-n // block_rows)), max(1, -(-n_anchors // group_anchors))

    def same(_key: tuple, block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(part):
            values, of = narrow(as_matrix(block["q"], width), as_matrix(part["q"], width))
            ids, own, label = (block[c].to_numpy() for c in ("id", "row", "label"))
            by_label: dict[int, Lists] = {}
            for i, (row, mine) in enumerate(zip(part["row"], part["label"])):
                if mine not in by_label:
                    held = np.flatnonzero(label == mine)
                    by_label[mine] = Lists(ids[held], own[held], values[held])
                if len((lists := by_label[mine]).ids):
                    places, scores = top(lists, of[i], row, n_positive)
                    out += [(row, int(lists.ids[p]), int(lists.rows[p]), int(s)) for p, s in zip(places, scores)]
        return pd.DataFrame(out, columns=["row", "positive_id", "positive_row", "score"])

    found = _cells(rows, anchors, *grid).applyInPandas(same, "row long, positive_id long, positive_row long, score long")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "positive_row")
    positives = stored(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n_positive), "positives")
    opened = positives.where(low * F.col("score") <= high * F.col("score"))  # any other window is empty
    asking = anchors.join(opened.groupBy("row").agg(F.sort_array(F.collect_set("score")).alias("scores")), "row")

    def other(_key: tuple, block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(part):
            values, of = narrow(as_matrix(block["q"], width), as_matrix(part["q"], width))
            label = block["label"].to_numpy()
            lists = Lists(block["id"].to_numpy(), block["row"].to_numpy(), values)
            for i, (row, mine, scores) in enumerate(zip(part["row"], part["label"], part["scores"])):
                for p, (places, s) in top_in_windows(lists, label != mine, of[i], [int(x) for x in scores], n_negative, low, high).items():
                    out += [(row, p, int(lists.ids[x]), int(lists.rows[x]), int(y)) for x, y in zip(places, s)]
        return pd.DataFrame(out, columns=["row", "score", "negative_id", "negative_row", "negative_score"])

    negatives = _cells(rows, asking, *grid).applyInPandas(other, "row long, score long, negative_id long, negative_row long, negative_score long")
    rank = Window.partitionBy("row", "score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    negatives = negatives.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n_negative)
    named = positives.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.join(negatives, ["row", "score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
