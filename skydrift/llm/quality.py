"""Quality rules whose cut-offs carry a guarantee.

A rule rejects a document when a measure of its text exceeds a cut-off. Labelled
documents choose the cut-offs: one half proposes a sequence of steps, the other
half, the holdout, tests it. A step lowers one rule's cut-off to a quantile of the
good documents; the loosest come first, and of those the ones that reject most bad
documents. A step stays only if it adds more of the bad than of the good. What all
steps so far reject together is certified when the exact binomial tail
P(Bin(n, max_rejection) <= k) of the k good holdout documents rejected among n is
at most the family's error. The sequence ends at the first step that fails, which
needs no correction for its length or the number of rules.

A stratum is a family of its own if its good holdout documents can certify
anything (k = 0). All others are one family, the pool; if even that is too small,
all strata are tested in it. Families share ``delta`` evenly; their number follows
from counts of documents alone, not from measures. With probability 1 - delta no
family's rules reject more than ``max_rejection`` of its good documents; in the
pool that holds for its documents together, not for each stratum.

All of it is DataFrame expressions. Texts are read once; their measures, a few
numbers per document, are stored in the shared folder, and thresholds and
verdicts come from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .line_dedup import lines_of
from .text import SPACE, fold_of, words

#: Measures a rule may bound from above, as expressions of the counts.
RULES: dict[str, Column | str] = {
    "symbols_per_char": "try_divide(n_symbols, word_chars)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "chars_per_word": "try_divide(word_chars, n_words)",
    "capital_share": "try_divide(n_capitals, word_chars)",
    "mark_share": "try_divide(n_marks, word_chars)",
}
#: Shares of the good documents that the candidates keep, loosest first.
LEVELS = [1.0, 0.9995, 0.999, 0.998, 0.995, 0.99]


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """The counts of every text. Windows of three words are compared by 64-bit hash, within one text only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"), words(text).alias("w"))
    n = F.size("w")
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.arrays_zip(F.slice("w", F.lit(1), n - 2).alias("a"), F.slice("w", F.lit(2), n - 2).alias("b"), F.slice("w", F.lit(3), n - 2).alias("c")), lambda t: F.xxhash64(t)))
    full = F.filter(lines_of(F.col("text")), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    only = lambda chars: F.char_length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")
    counted = base.select(
        "id", "row", "stratum", n.cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_capitals"), only("!?#*$%&|<>=~^").alias("n_marks"), full.alias("full"), triples.alias("t"))
    counted = counted.select(
        "*", F.size("full").cast("long").alias("n_lines"), (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        (F.size(F.array_distinct("t")) < F.size("t")).alias("again"))
    # equal windows stand side by side once sorted; each reaches three words on, or to where the next one starts
    ranked = F.when(F.col("again"), F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("s", ranked).drop("t", "full")
    m = F.size("s")
    twins = F.zip_with(F.slice("s", F.lit(1), m - 1), F.slice("s", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    counted = counted.withColumn("p", F.when(F.col("again"), F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))).drop("s")
    q = F.size("p")
    steps = F.zip_with(F.slice("p", F.lit(1), q - 1), F.slice("p", F.lit(2), q - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(F.col("again"), F.aggregate(steps, F.lit(3), lambda acc, x: acc + x)).otherwise(0)
    return counted.select("id", "row", "stratum", "n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(Bin(n, p) <= k), term by term from the exact recurrence, summed in logarithms."""
    start = n * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)
    done = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))),
        F.struct(start.alias("term"), start.alias("total")),
        lambda acc, i: F.when(i > k, acc).otherwise(_next_term(acc, i, n, odds)))
    return F.least(F.lit(1.0), F.exp(done["total"]))


def _next_term(acc: Column, i: Column, n: Column, odds: Column) -> Column:
    term = acc["term"] + F.log((n - i + 1).cast("double") / i) + odds
    high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
    return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))


def families(labelled: DataFrame, max_rejection: float, delta: float) -> tuple[DataFrame, float]:
    """``stratum_key`` and ``family`` that judges it, ``tests``, the families its documents test, and the error of each family."""
    sizes = labelled.groupBy("stratum_key").agg(F.count_if(F.col("good") & ~F.col("proposes")).alias("n"))
    strata = sizes.count()
    enough = lambda n, error: n * F.log1p(F.lit(-max_rejection)) <= F.log(F.lit(error))
    sizes = sizes.withColumn("alone", enough(F.col("n"), delta / (strata + 1)))
    alone, rest = sizes.agg(F.count_if("alone"), F.coalesce(F.sum(F.when(~F.col("alone"), F.col("n"))), F.lit(0))).first()
    error = delta / max(1, alone + (alone < strata))
    pool, own = F.lit("pool"), F.col("stratum_key")
    short = F.lit(alone < strata) & ~enough(F.lit(rest), error)
    return sizes.select("stratum_key", F.when(F.col("alone"), own).otherwise(pool).alias("family"),
                        F.when(~F.col("alone"), F.array(pool)).when(short, F.array(own, pool)).otherwise(F.array(own)).alias("tests")), error


def first_step(seen: DataFrame, steps: DataFrame) -> DataFrame:
    """The documents of every family with ``first``, the number of the first of its steps that rejects them; null if none does."""
    over = lambda e, i: F.when(F.col("values")[e["rule"]] > e["cutoff"], i)
    return seen.join(F.broadcast(steps), "family").withColumn("first", F.array_min(F.transform("steps", over)))  # steps: one row per family


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rejection: float, delta: float) -> DataFrame:
    """The strictest certified cut-off per stratum and rule: ``stratum_key``, ``rule``, ``cutoff``.

    Null labels and null ids do not count; of contradicting labels the lowest holds. A
    stratum without labels has no cut-offs, and no one has any without bad documents that propose.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    values = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.expr(f"double({e})") for e in RULES.values()]))
    labelled = stored(measured.where(~base_failed()).join(marks, "id").select(
        stratum_key().alias("stratum_key"), (F.col("good") == 1).alias("good"), (fold_of(F.col("id")) < 2).alias("proposes"), values.alias("values")), "labelled")
    judges, error = families(labelled, max_rejection, delta)
    judges = stored(judges, "families")
    seen = labelled.join(F.broadcast(judges), "stratum_key").withColumn("family", F.explode("tests")).select("family", "good", "proposes", "values")
    single = seen.where("proposes").select("family", "good", F.explode("values").alias("rule", "value"))
    cuts = (
        single.where("good").groupBy("family", "rule").agg(F.percentile_approx("value", LEVELS, 100_000).alias("cuts"))
        .select("family", "rule", F.posexplode("cuts").alias("rank", "cutoff"))
    )
    ordered = (
        single.where("NOT good").join(F.broadcast(cuts), ["family", "rule"]).where("value > cutoff").groupBy("family", "rule", "rank", "cutoff").agg(F.count(F.lit(1)).alias("hits"))
        .groupBy("family").agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("hits")).alias("fewer"), "rule", "cutoff"))).alias("steps"))  # one entry per rule and level
    )
    ordered = stored(ordered, "steps")
    fresh = first_step(seen.where("proposes"), ordered).groupBy("family", "steps", "first").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    fresh = fresh.groupBy("family", "steps").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("first", "good", "bad")).alias("new"))
    useful = lambda e: F.col("n_good") * e["bad"] > F.col("n_bad") * e["good"]
    at = F.sort_array(F.transform(F.filter("new", lambda e: e["first"].isNotNull() & useful(e)), lambda e: e["first"]))
    chosen = stored(fresh.select("family", F.transform(at, lambda i: F.get("steps", i)).alias("steps")), "chosen")
    tested = first_step(seen.where("good AND NOT proposes"), chosen).groupBy("family", "steps", "first").agg(F.count(F.lit(1)).alias("c"))
    tested = tested.groupBy("family", "steps").agg(F.sum("c").alias("n"), F.collect_list(F.struct("first", "c")).alias("new"))
    tested = tested.select("family", "n", "new", F.posexplode("steps").alias("step", "e"))
    tested = tested.withColumn("k", F.aggregate("new", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("step"), x["c"]).otherwise(0)))
    alpha = F.lit(max_rejection)
    failed = F.when(F.col("k") >= F.col("n") * alpha, 1.0).otherwise(binomial_tail(F.col("n"), F.col("k"), alpha)) > error
    tested = tested.select("family", "step", "e.rule", "e.cutoff", failed.alias("failed"))
    chain = tested.groupBy("family").agg(F.min(F.when(F.col("failed"), F.col("step"))).alias("end"), F.collect_list(F.struct("step", "rule", "cutoff")).alias("chain"))
    passed = chain.select("family", F.explode("chain").alias("e"), "end").where(F.col("end").isNull() | (F.col("e.step") < F.col("end")))
    passed = passed.groupBy("family", "e.rule").agg(F.min("e.cutoff").alias("cutoff"))
    return judges.join(passed, "family").select("stratum_key", "rule", "cutoff")


def stratum_key() -> Column:
    """The stratum, apart from the family ``pool`` and from null."""
    return F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("null"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality",
                  max_rejection: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: its id, ``row`` (a hash of its text), the counts, ``base_failed``, ``kept`` and ``broken``, the rules it broke.

    Null or empty text has no words and fails the base rules. Null strata form a
    stratum of their own. ``max_rejection`` and ``delta`` hold for each stratum with
    enough labels, and for all others together. Rows that repeat an id or a text are judged one by
    one, all alike. Empty ``labels``: the base rules alone. Empty ``docs``: no rows.
    """
    measured = stored(measures(docs, id_col, text_col, stratum_col), "measures")
    cuts = thresholds(measured, labels, id_col, label_col, max_rejection, delta)
    cuts = stored(cuts.groupBy("stratum_key").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")), "cutoffs")  # at most one entry per rule
    joined = measured.withColumn("stratum_key", stratum_key()).join(cuts, "stratum_key", "left")
    broken = F.filter(F.array(*[F.when(F.expr(f"double({e})") > F.col("cuts")[name], F.lit(name)) for name, e in RULES.items()]), lambda r: r.isNotNull())
    judged = joined.withColumn("base_failed", base_failed()).withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
    return judged.select(F.col("id").alias(id_col), "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")
