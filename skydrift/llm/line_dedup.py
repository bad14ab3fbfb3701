"""Lines that too many documents share, dropped from all documents but one.

Lines are exploded as (document, hash of the normalised line); an aggregation
that combines before the shuffle counts documents per hash, so a line held by a
third of all documents is one row per task. Only lines over the threshold meet
the exploded lines again, in a plain equi-join that adaptive execution splits
where one hash is hot. Texts are shuffled once, to take their lists of dropped
positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, ascii_lower


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_lines``, ``n_dropped``, the ``kept_text`` and the columns named in ``carry``.

    A line's key is the line without white space at its ends, A-Z lowered. Keys of
    ``min_chars`` code points or more found in ``min_docs`` documents or more lose
    all their lines but those of the largest id that holds them. Keys are compared
    by md5, 128 bits.

    Null or empty text: one empty line, which stays. Rows of one id are one document;
    each is returned, and rows with the largest id all keep their lines. Rows without
    an id are one document too, and a null id is smaller than any other. No rows: no
    rows.
    """
    more = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), more.alias("more")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = F.transform(lines_of(F.col("text")), lambda line: F.when(F.char_length(line) >= min_chars, line_key(line)))
    hashed = docs.select("id", "row", F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.md5(k))).alias("keys"))
    heavy = (
        hashed.select("id", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key")).distinct()  # a document may be several rows
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("key", "keeper")
    )
    drops = (
        hashed.select("id", "row", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull())
        .join(heavy, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))
    )
    d, x = docs.alias("d"), drops.alias("x")
    both = d.join(x, F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.row") == F.col("x.row")), "left").select("d.id", "text", "more", lines_of(F.col("text")).alias("lines"), "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return both.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")).alias("kept_text"),
        *[F.col("more")[c].alias(c) for c in carry or []],
    )
