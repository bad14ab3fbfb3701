"""Exact order statistics of many groups, and of coarser groups of those, in two scans.

The first scan keeps a count and a quantile sketch per finest group; sketches of
coarser groups are merged from them. A sketch brackets every wanted rank. The second
scan counts, per finest group, rows between the brackets and rows of each value inside
one; ranks inside a bracket then follow from running totals. Groups of any size take
the same way: a bracket that would hold too many rows is bracketed again by sketches of
what it holds, and one that misses its rank (a sketch may be off) is widened until
none does. The driver sees counts of groups only.

Nulls and NaN do not count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import order

#: Size parameter of the sketches, and the share of rows by which a bracket exceeds its rank on either side.
SKETCH, SLACK = 4096, 3 * 2.296 / 4096**0.9021
#: Groups of up to so many rows are one bracket. Above, a rank is less than SLACK + 1 / WHOLE of the rows.
WHOLE = 2000
#: Rows that all brackets of a group may hold before they are narrowed, and the grid of a narrowing sketch.
HELD, GRID = 2_000_000, 512


@dataclass(frozen=True)
class Wanted:
    """Percentiles of each group of ``keys``, which are among the finest keys."""

    keys: tuple[str, ...]
    probs: tuple[float, ...]


@dataclass(frozen=True)
class Selection:
    """``groups`` has the first scan's aggregates per finest group; ``found`` both neighbours of every wanted rank."""

    groups: DataFrame
    found: DataFrame
    wanted: tuple[Wanted, ...]

    def percentiles(self, of: Wanted | None = None, out: str = "pct", through: Callable[[Column], Column] = lambda c: c) -> DataFrame:
        """Linear interpolation between neighbours, of the first set by default. ``through``, a rising function, is applied to them first: the percentiles of the transformed values."""
        which = self.wanted.index(of) if of else 0
        value = F.transform("_q", lambda s: through(s["low"]) * (1.0 - s["frac"]) + through(s["high"]) * s["frac"])
        return self.found.where(F.col("_w") == which).select(*self.wanted[which].keys, value.alias(out))


def _spread(table: DataFrame, fine: Sequence[str], wanted: Sequence[Wanted], keep: Sequence[str]) -> DataFrame:
    """A row per wanted set, numbered ``_w``, with the keys that the set does not group by set to null."""
    kinds = dict(table.dtypes)
    each = [F.struct(F.lit(i).alias("_w"), *[(F.col(k) if k in w.keys else F.lit(None).cast(kinds[k])).alias(k) for k in fine]) for i, w in enumerate(wanted)]
    return table.select(F.explode(F.array(*each)).alias("_s"), *[F.col(c) for c in keep]).select("_s.*", *keep)


def _per_set(wanted: Sequence[Wanted], of: Callable[[int, Wanted], Column]) -> Column:
    out = None
    for i, w in enumerate(wanted):
        out = F.when(F.col("_w") == i, of(i, w)) if out is None else out.when(F.col("_w") == i, of(i, w))
    return out


def _slots(wanted: Sequence[Wanted]) -> list[tuple[int, float]]:
    return [(i, p) for i, w in enumerate(wanted) for p in w.probs]


def _by_group(groups: DataFrame, fine: Sequence[str], wanted: Sequence[Wanted], brackets: DataFrame) -> DataFrame:
    """Brackets (_w, fine, _slot, _lo, _hi) as one row per finest group with columns ``_lo0``, ``_hi0``, ..."""
    own = _spread(groups.select(*fine, *[F.col(k).alias(f"_own{i}") for i, k in enumerate(fine)]), fine, wanted, [f"_own{i}" for i in range(len(fine))])
    j = order.join_null_safe(own, brackets, ["_w", *fine]).drop(*fine)
    at = lambda c, s: F.max(F.when(F.col("_slot") == s, F.col(c))).alias(f"{c}{s}")
    n = range(len(_slots(wanted)))
    rows = j.groupBy(*[f"_own{i}" for i in range(len(fine))]).agg(*[at("_lo", s) for s in n], *[at("_hi", s) for s in n])
    return rows.withColumnsRenamed({f"_own{i}": k for i, k in enumerate(fine)})


def _first_bounds(groups: DataFrame, fine: Sequence[str], wanted: Sequence[Wanted], slack: float, few: bool) -> DataFrame:
    """One row per finest group with the brackets that the first scan's sketches give."""
    inf, out, number = float("inf"), groups.where("_n > 0"), 0
    for w in wanted:
        src, n, sketch = out, "_n", "_sketch"
        own = set(w.keys) == set(fine)
        if not own:
            src = groups.where("_n > 0").groupBy(*w.keys).agg(F.sum("_n").alias("_all"), F.kll_merge_agg_double("_sketch").alias("_merged"))
            n, sketch = "_all", "_merged"
        ends = []
        for p in w.probs:
            at = lambda q, end: F.when(F.col(n) > WHOLE, F.kll_sketch_get_quantile_double(sketch, F.lit(q))).otherwise(F.lit(end)) if 0 < q < 1 else F.lit(end)  # noqa: E731, B023
            ends += [at(p - slack, -inf).alias(f"_lo{number}"), at(p + slack, inf).alias(f"_hi{number}")]
            number += 1
        if own:
            out = out.select("*", *ends)
        else:
            src = src.select(*w.keys, *ends)
            out = order.join_null_safe(out, F.broadcast(src) if few else src, w.keys) if w.keys else out.select("*", *_scalars(src))
    return out.select(*fine, *[f"{c}{s}" for s in range(number) for c in ("_lo", "_hi")])


def _scalars(one: DataFrame) -> list[Column]:
    """Columns of a table of one row."""
    row = one.select(F.struct(*one.columns)).scalar()
    return [row[c].alias(c) for c in one.columns]


def _narrowed(data: DataFrame, bounds: DataFrame, groups: DataFrame, fine: Sequence[str], wanted: Sequence[Wanted], slack: float) -> tuple[DataFrame, int]:
    """Brackets of the ranks inside the last ones (``bounds``, which ``data`` has beside its rows), and how many rows they may hold now."""
    slots, v = _slots(wanted), F.col("_v")
    # rows below a bracket are only counted; what goes to the sketches are the few rows inside one
    counts = order.join_null_safe(data.groupBy(*fine).agg(*[F.count_if(v < F.col(f"_lo{s}")).alias(f"_u{s}") for s in range(len(slots))]), bounds, fine)
    each = [F.struct(F.lit(s).alias("_slot"), F.col(f"_lo{s}").alias("_lo"), F.col(f"_hi{s}").alias("_hi"), F.col(f"_u{s}").alias("_under")) for s in range(len(slots))]
    under = counts.select(*fine, F.inline(F.array(*each)))
    within = [(v >= F.col(f"_lo{s}")) & (v <= F.col(f"_hi{s}")) for s in range(len(slots))]
    some = within[0]
    for w in within[1:]:
        some = some | w
    here = F.filter(F.array(*[F.struct(F.lit(s).alias("_slot"), w.alias("in")) for s, w in enumerate(within)]), lambda x: x["in"])
    rows = data.where(some).select(*fine, "_v", F.inline(here))
    of_slot = F.create_map(*[F.lit(x) for s, (i, _) in enumerate(slots) for x in (s, i)])
    inside = rows.groupBy(*fine, "_slot").agg(F.count("_v").alias("_in"), F.kll_sketch_agg_double("_v", SKETCH).alias("_sketch"))
    parts = order.join_null_safe(under, inside, [*fine, "_slot"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    spread = _spread(parts, fine, wanted, ["_slot", "_lo", "_hi", "_under", "_in", "_sketch"]).where(of_slot[F.col("_slot")] == F.col("_w"))
    merged = spread.groupBy("_w", *fine, "_slot", "_lo", "_hi").agg(F.sum("_under").alias("_under"), F.sum("_in").alias("_in"), F.kll_merge_agg_double("_sketch").alias("_sketch"))
    total = _spread(groups, fine, wanted, ["_n"]).groupBy("_w", *fine).agg(F.sum("_n").alias("_n"))
    p = F.create_map(*[F.lit(x) for s, (_, q) in enumerate(slots) for x in (s, float(q))])[F.col("_slot")]
    grid = F.when(F.col("_in") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])))
    rank = p * (F.col("_n") - 1) - F.col("_under")
    low = F.floor(GRID * ((rank - 1) / F.col("_in") - slack)).cast("int")
    high = F.ceil(GRID * ((rank + 2) / F.col("_in") + slack)).cast("int")
    new = order.join_null_safe(merged, total, ["_w", *fine]).select(
        "_w", *fine, "_slot", F.when(low > 0, F.get(grid, low)).otherwise(F.col("_lo")).alias("_lo"), F.when(high < GRID, F.get(grid, high)).otherwise(F.col("_hi")).alias("_hi"),
        (F.col("_in") * (2 * slack + 2 / GRID)).alias("_left"))
    new = stored(new, "brackets")
    left = new.where(F.col("_lo") < F.col("_hi")).agg(F.sum("_left")).first()[0]
    return _by_group(groups, fine, wanted, new.drop("_left")), int(left or 0)


def select(df: DataFrame, fine: Sequence[str], value: str, wanted: Sequence[Wanted], aggs: Sequence[Column] = (), held: int = HELD, slack: float = SLACK) -> Selection:
    """Aggregates per ``fine`` group and the neighbours of all wanted ranks. Runs both scans."""
    fine = list(fine) or ["_one"]
    wanted = tuple(wanted) if fine != ["_one"] else tuple(Wanted(("_one",), w.probs) for w in wanted)
    df = df.withColumn("_one", F.lit(0)) if fine == ["_one"] else df
    x = F.col(value).cast("double")
    df = df.withColumn("_v", F.when(~F.isnan(x), x))
    groups = stored(df.groupBy(*fine).agg(*aggs, F.count("_v").alias("_n"), F.kll_sketch_agg_double("_v", SKETCH).alias("_sketch")), "groups")
    data = df.select(*fine, "_v").where("_v IS NOT NULL")
    n_groups, n = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    few = n_groups <= order.BROADCAST_ROWS
    beside = lambda bounds: order.join_null_safe(data, F.broadcast(bounds) if few else bounds, fine)
    slots = range(len(_slots(wanted)))
    while True:
        bounds = _first_bounds(groups, fine, wanted, slack + 1 / WHOLE, few)
        left, last = int(n * 2 * slack * max(len(w.probs) for w in wanted)), None
        while left > held and (last is None or left < last / 2):
            last = left
            bounds, left = _narrowed(beside(bounds), bounds, groups, fine, wanted, slack)
            bounds = stored(bounds, "bounds")
        v, inside, passed = F.col("_v"), F.lit(False), F.lit(0)
        for s in slots:
            inside, passed = inside | ((v >= F.col(f"_lo{s}")) & (v <= F.col(f"_hi{s}"))), passed + (v >= F.col(f"_lo{s}")).cast("int") + (v > F.col(f"_hi{s}")).cast("int")
        cells = beside(bounds).select(*fine, "_v", passed.alias("_at"), F.when(inside, v).alias("_x"))
        cells = cells.groupBy(*fine, "_at", "_x").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_m"))
        found = stored(_found(cells, fine, wanted), "found")
        if found.where(F.exists("_q", lambda q: ~q["sure"])).isEmpty():
            shown = [Wanted((), w.probs) if fine == ["_one"] else w for w in wanted]
            return Selection(groups.drop("_sketch", "_one"), found, tuple(shown))
        slack *= 8


def _found(cells: DataFrame, fine: Sequence[str], wanted: Sequence[Wanted]) -> DataFrame:
    """(_w, fine, _q): per probability the values at the ranks around it. A value between brackets stands for its whole cell and is not sure."""
    t = cells.withColumn("_sure", F.col("_x").isNotNull())
    if len(wanted) == 1 and set(wanted[0].keys) == set(fine):
        t = t.withColumn("_w", F.lit(0))
    else:
        t = _spread(t, fine, wanted, ["_m", "_n", "_sure"]).groupBy("_w", *fine, "_m").agg(F.sum("_n").alias("_n"), F.min("_sure").alias("_sure"))
    group = Window.partitionBy("_w", *fine)
    upto = F.sum("_n").over(group.orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = t.withColumn("_end", upto).withColumn("_all", F.sum("_n").over(group))
    pos = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    spot = lambda i, p, side, of: F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), of(pos(p)).alias("rank"), (pos(p) - F.floor(pos(p))).alias("frac"))
    spots = _per_set(wanted, lambda _, w: F.array(*[spot(i, p, side, of) for i, p in enumerate(w.probs) for side, of in ((0, F.floor), (1, F.ceil))]))
    here = F.filter(spots, lambda s: (s["rank"] < F.col("_end")) & (s["rank"] >= F.col("_end") - F.col("_n")))
    hit = t.select("_w", *fine, "_m", "_sure", F.explode(here).alias("_s")).select("_w", *fine, "_m", "_sure", "_s.*")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("_m")))
    per = hit.groupBy("_w", *fine, "i").agg(side(0).alias("low"), side(1).alias("high"), F.max("frac").alias("frac"), F.min("_sure").alias("sure"))
    return per.groupBy("_w", *fine).agg(F.array_sort(F.collect_list(F.struct("i", "low", "high", "frac", "sure"))).alias("_q"))


def grouped_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "pct") -> DataFrame:
    """Exact linear-interpolated percentiles per group, as one array column."""
    return select(df, keys, value, [Wanted(tuple(keys), tuple(probs))]).percentiles(out=out)


def stats_with_percentiles(df: DataFrame, keys: Sequence[str], value: str, aggs: Sequence[Column], probs: Sequence[float], out: str = "pct") -> DataFrame:
    """Built-in aggregates and exact percentiles of one column, per group; a group without a value has null percentiles."""
    s = select(df, keys, value, [Wanted(tuple(keys), tuple(probs))], aggs)
    if not keys:
        return s.groups.drop("_n").withColumn(out, s.percentiles(out=out).select(out).scalar())
    return order.join_null_safe(s.groups.drop("_n"), s.percentiles(out=out), list(keys), "left")
