"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hash of every run of ``w`` k-grams. Two
texts that share ``k + w - 1`` words share a run, hence its least hash: no shared
span of that length is missed. Test and training fingerprints meet in one join,
and only documents with a hit are looked at again: around each hit the full
windows are compared with the windows of the benchmark, word for word.

The fingerprints of the benchmark are stored first, so that the engine knows
their size and broadcasts them only below its own threshold; otherwise the join
shuffles, and adaptive execution splits a hash that many documents hold.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text import ascii_lower

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and anything beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda x: x != "")


def grams(words: str, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words, in order; empty where there are fewer."""
    n = F.size(words) - (k - 1)
    shifted = [F.slice(words, F.lit(j + 1), n).alias(f"w{j}") for j in range(k)]
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.arrays_zip(*shifted), lambda t: F.xxhash64(t)))


def winnow(hashes: str, w: int) -> Column:
    """The distinct least hashes of every ``w`` neighbours."""
    n = F.size(hashes) - (w - 1)
    mins = F.transform(F.arrays_zip(*[F.slice(hashes, F.lit(j + 1), n).alias(f"h{j}") for j in range(w)]), lambda t: F.least(*[t[f"h{j}"] for j in range(w)]))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.array_distinct(mins))


def _sized(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda h: F.struct(h.alias("print"), F.lit(n).alias("size")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: its id, ``row`` (a hash of its text), ``n_words``, ``n_hit``, ``items`` (sorted ids, as text) and ``contaminated``.

    A window is ``window`` words of an item in a row; an item of fewer words is one
    window. A document's word is hit when it lies in an occurrence of a window.
    Winnowing covers windows of full length; each shorter length that the
    benchmark holds adds the hashes of its whole windows to the fingerprints, so
    these are exact as well.

    Null or empty text has no words and no hits, a null or empty item no windows.
    Rows that repeat an id are judged one by one and a repeated item counts once. A
    null item id is left out of the list. Empty tables give no rows or no hits.
    """
    w = window - k + 1
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    worded = docs.select("id", "row", item_words(F.col("text")).alias("words"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), item_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    windows = (
        items.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
        .groupBy("size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("span")).agg(F.collect_set("item").alias("items"))
    )
    windows = stored(windows, "windows")
    shorter = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # fewer than ten numbers
    tests = (
        windows.where(F.col("size") == window).select(F.split("span", " ").alias("words"))
        .select(grams("words", k).alias("g")).select(F.explode(winnow("g", w)).alias("print"), F.lit(window).alias("size"))
    )
    for n in shorter:
        tests = tests.unionByName(windows.where(F.col("size") == n).select(F.split("span", " ").alias("words")).select(F.explode(grams("words", n)).alias("print"), F.lit(n).alias("size")))
    tests = stored(tests.distinct(), "prints")

    hashed = worded.select("id", "row", F.size("words").cast("long").alias("n_words"), "words", grams("words", k).alias("g"))
    marks = F.concat(_sized(winnow("g", w), window), *[_sized(F.array_distinct(grams("words", n)), n) for n in shorter])
    suspects = (
        hashed.select("id", "row", F.explode(marks).alias("m")).select("id", "row", "m.*")
        .join(tests, ["print", "size"]).groupBy("id", "row").agg(F.collect_set("size").alias("sizes"))
    )
    suspects = stored(suspects, "suspects")
    d, x = docs.distinct().alias("d"), suspects.alias("x")
    near = d.join(x, F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.row") == F.col("x.row"))).select("d.id", "d.row", item_words(F.col("text")).alias("words"), F.explode("sizes").alias("size"))
    spans = (
        near.where(F.size("words") >= F.col("size"))
        .select("id", "row", "size", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
        .select("id", "row", "size", "at", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("span"))
    )
    hits = (
        spans.join(windows, ["size", "span"]).groupBy("id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    # windows in order of their starts: each adds what reaches beyond the last end
    reach = F.aggregate("at", F.struct(F.lit(1).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["at"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n")))
    hits = hits.select("id", "row", reach["n"].cast("long").alias("n_hit"), "items")
    c, h = hashed.select("id", "row", "n_words").alias("c"), hits.alias("h")
    return c.join(h, F.col("c.id").eqNullSafe(F.col("h.id")) & (F.col("c.row") == F.col("h.row")), "left").select(
        F.col("c.id").alias(id_col), F.col("c.row").alias("row"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
