"""URL lists that change over time: every capture is judged by the entries active when it was fetched.

Dated list entries become validity intervals, one per pattern and change. A URL
has few keys that a pattern can name: its host, the domains above it, and its
path prefixes. Captures and intervals meet on (key, period): an interval has a
row for each period it touches, so a capture sees only the versions of its
own period, however long a pattern's history, and the time condition picks the
one in force. A host with a third of all captures is an equi-join with skew on one
side, which adaptive execution splits; pages themselves never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased, without user or port; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*|\.)$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The patterns that match a URL, each with its rank: domains from two labels on, the host, then ever longer path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.least(F.lit(2), n), n), lambda i: F.struct(F.array_join(F.slice(labels, n - i + 1, i), ".").alias("key"), i.alias("rank")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    m = F.size(parts)
    prefixes = F.transform(
        F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key"), (i + 1000).alias("rank")))
    return F.when(host == "", F.array().cast("array<struct<key:string,rank:int>>")).otherwise(F.concat(domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``pattern``, ``verdict``, ``valid_from``, ``valid_to`` (exclusive, null while open) of entries ``pattern``, ``verdict``, ``effective_at``.

    An entry holds until the pattern's next one. Of entries of one pattern and time
    a block holds before an allowance, and that before ``none``, which lifts what
    was. Null patterns, verdicts and times do not count.
    """
    sure = entries.where(F.col("pattern").isNotNull() & F.col("verdict").isNotNull() & F.col("effective_at").isNotNull())
    strict = F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "allow", 1).otherwise(0)
    one = sure.groupBy("pattern", F.col("effective_at").alias("valid_from")).agg(F.max_by("verdict", F.struct(strict, "verdict")).alias("verdict"))
    then = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return one.select("pattern", "verdict", "valid_from", then.alias("valid_to"))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", period: str = "day") -> DataFrame:
    """One row per row of ``captures``: its id, time, ``verdict``, the ``pattern`` that gave it and ``n_active``, the matching entries in force.

    The longest matching pattern in force decides; a ``none`` entry lifts its own
    pattern only. Without any: verdict ``none`` and no pattern, as for null or
    malformed URLs and null times. Rows that repeat an id and URL at one time are
    judged alike. An empty list judges every capture ``none``.
    """
    spans = validity(entries).where("verdict <> 'none'")
    asked = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    last = asked.agg(F.max("at")).first()[0]
    end = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last).cast("timestamp"))
    by_period = spans.where(F.col("valid_from") <= F.lit(last).cast("timestamp")).withColumn(
        "period", F.explode(F.sequence(F.date_trunc(period, "valid_from"), F.date_trunc(period, end), F.expr(f"INTERVAL 1 {period}"))))
    probes = asked.select("id", "url", "at", F.explode(keys_of(F.col("url"))).alias("k")).select("id", "url", "at", F.col("k.key").alias("pattern"), "k.rank", F.date_trunc(period, "at").alias("period"))
    hits = probes.join(by_period, ["pattern", "period"]).where("valid_from <= at AND (valid_to IS NULL OR at < valid_to)")
    judged = hits.groupBy("id", "url", "at").agg(F.max(F.struct("rank", "pattern", "verdict")).alias("best"), F.count_distinct("pattern").alias("n_active"))
    a, j = asked.alias("a"), judged.alias("j")
    same = F.col("a.id").eqNullSafe(F.col("j.id")) & F.col("a.url").eqNullSafe(F.col("j.url")) & F.col("a.at").eqNullSafe(F.col("j.at"))
    return a.join(j, same, "left").select(
        F.col("a.id").alias(id_col), F.col("a.at").alias(time_col), F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
