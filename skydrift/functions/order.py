"""Global order without a global sort: prefix sums, ranks, the next item.

A single unpartitioned window puts a whole group into one task. Here rows are dealt
into ranges of the ordering column once, each range is handled on its own, and only
the per-range totals - a table as small as the number of ranges times the number of
groups - are put in sequence. One group that holds most rows is therefore spread like
any other. Where the ranges are cut decides balance only; results do not depend on it.
Percentiles are in ``functions.select``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# a group row is some hundred bytes at most
BROADCAST_ROWS = 200_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Gives a scan with fewer splits than cores one shuffle by ``keys``.

    A single small file is read by one task, which would then do all per-row
    work alone. Tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a key in one partition: groupings by ``keys``, alone or with others, then move nothing."""
    return df.repartition(*[F.col(k) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys (nulls match); the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(renamed, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def join_few(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows joined to a stored table of one row per group: broadcast up to ``BROADCAST_ROWS`` rows by count, else joined the usual way."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return join_null_safe(df, F.broadcast(table) if few else table, keys, how)


def join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows joined to a table of one row per group, without shuffling the rows.

    Catalyst cannot know that an aggregate is small, and a sort-merge join would
    send every row to one of a few group keys. So the group table is computed once
    into the shared folder and counted (:func:`join_few`).
    """
    return join_few(df, stored(stats, "stats"), keys, how)


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """The table in ranges of ``by``, each row with the number of its range in ``_bucket``.

    Ranges come from the engine's own range partitioning and cost no lookup per row.
    They are stored with the rows, so every later job, and a task that runs again,
    sees the same. Equal rows share a range; a group spans as many ranges as it needs.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return stored(df.repartitionByRange(parts, *by).withColumn("_bucket", F.spark_partition_id()), "ranges")


def _with_offsets(b: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Adds ``_before``, the weight of the group's earlier ranges, and ``_all``, its whole weight; ``b`` is stored."""
    totals = b.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_w"))
    return join_group_stats(b, _bucket_offsets(totals, keys).drop("_w"), [*keys, "_bucket"])


def prefix_sum(df: DataFrame, keys: Sequence[str], order: str, weight: str, out: str = "running", total: str | None = None) -> DataFrame:
    """Running total of ``weight`` by ascending ``order`` within ``keys``.

    ``order`` should be unique within a group (aggregate first). ``total`` names
    an optional column with the group's whole weight.
    """
    keys = list(keys)
    b = _with_offsets(ranged(df, *keys, order), keys, F.col(weight))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    running = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.withColumn(out, running + F.col("_before"))
    if total:
        b = b.withColumn(total, F.col("_all"))
    return b.drop("_bucket", "_before", "_all")


def weighted_ranks(cells: DataFrame, keys: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Mean rank of every cell's value, less the group's mean rank, where a cell stands for ``weight`` rows.

    A value may occur in several cells; they share its rank. Running counts only:
    nothing is joined on the value.
    """
    keys = list(keys)
    b = _with_offsets(ranged(cells, *keys, value), keys, F.col(weight))
    upto = F.sum(weight).over(Window.partitionBy(*keys, "_bucket").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(weight).over(Window.partitionBy(*keys, "_bucket", value))
    rank = F.col("_before") + upto - ties + (ties + 1) / 2.0 - (F.col("_all") + 1) / 2.0
    return b.withColumn(out, rank).drop("_bucket", "_before", "_all")


def _bucket_offsets(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight before each range and in the whole group; one small row per range."""
    part = list(keys) or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("_bucket")
    return totals.withColumn(
        "_before",
        F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_w") - F.col("_w")),
    ).withColumn("_all", F.sum("_w").over(Window.partitionBy(*part)))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rank within ``keys`` from 1, ties sharing their mean rank, nulls unranked."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value, out).drop(f"{out}_ties")
    return join_null_safe(df, ranks, keys + [value], "left")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", centered: bool = False) -> DataFrame:
    """One row per distinct (keys, value) with its mean rank and tie count.

    ``centered`` takes off the group's mean rank, which is always (n + 1) / 2.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = prefix_sum(counts, keys, value, "_n", "_upto", "_total" if centered else None)
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    return run.select(
        *keys,
        value,
        (rank - (F.col("_total") + 1) / 2.0 if centered else rank).alias(out),
        F.col("_n").alias(f"{out}_ties"),
    )


def ordinal(df: DataFrame, order: str, out: str = "ordinal") -> DataFrame:
    """Consecutive numbers from 0 by ``order`` (unique), without one big sort."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return prefix_sum(one, [], order, "_one", "_pos").withColumn(out, F.col("_pos") - 1).drop("_one", "_pos")


# --- order by hash -----------------------------------------------------------

def hash_key(seed, *keys: Column) -> Column:
    """Hex digest that fixes a reproducible random order, the same on any engine."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_thresholds(df: DataFrame, digest: str, fractions: Sequence[float] = (), digits: int = 4, ranks: Sequence[int] = ()) -> DataFrame:
    """One row: the digest at rank int(f*n) for every fraction, or at the given ranks; null beyond the last row.

    Digests are uniform, so their first hex digits are ready-made even ranges.
    Only the few ranges that hold a wanted rank are sorted.
    """
    b = df.select(digest, F.substring(digest, 1, digits).alias("_bucket"))
    counts = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_w"))
    offs = _bucket_offsets(counts, [])
    spots = F.array(
        *[
            F.struct(F.lit(i).alias("i"), rank.alias("rank"))
            for i, rank in enumerate([*[F.floor(F.lit(float(f)) * F.col("_all")) for f in fractions], *[F.lit(int(r)).cast("long") for r in ranks]])
        ]
    )
    need = (
        offs.withColumn("_s", F.explode(spots))
        .select("_bucket", "_before", F.col("_s.i").alias("_i"), F.col("_s.rank").alias("_rank"), "_w", "_all")
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_w")))
    )
    rows = b.join(F.broadcast(need.select("_bucket").distinct()), "_bucket", "left_semi")
    w = Window.partitionBy("_bucket").orderBy(digest)
    ranked = rows.withColumn("_in", F.row_number().over(w) - 1)
    hit = ranked.join(F.broadcast(need), "_bucket").where(F.col("_in") + F.col("_before") == F.col("_rank"))
    return hit.agg(
        *[F.max(F.when(F.col("_i") == i, F.col(digest))).alias(f"t{i}") for i in range(len(fractions) + len(ranks))]
    )


def lowest_per_group(df: DataFrame, group: Sequence[str], digest: str, n: int, digits: int = 4) -> DataFrame:
    """The rows with the n lowest digests of every group, however large a group is.

    Rows are counted per group and leading digits of the digest (one map-side
    combined shuffle). Only the ranges that start before rank n are kept, so the
    final ranking sees little more than n rows per group.
    """
    keys = list(group)
    b = df.withColumn("_bucket", F.substring(digest, 1, digits))
    offs = _bucket_offsets(b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_w")), keys)
    kept = join_group_stats(b, offs.where(F.col("_before") < n).select(*keys, "_bucket"), keys + ["_bucket"])
    w = Window.partitionBy(*keys).orderBy(digest)
    return kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_bucket")
