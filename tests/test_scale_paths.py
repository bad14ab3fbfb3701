"""The large-table paths give the same answers as the small ones, also under skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.functions import order, select
from skydrift.operators import bands, distance, embedding, pairing, significance, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """Group g0 holds most rows, and a third of all rows share one value."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        g = "g0" if i % 5 else f"g{i % 7}"
        v = 7.0 if i % 3 == 0 else float(round(rng.lognormal(2, 1.5), 2))
        rows.append((i, g, None if i % 97 == 0 else v))
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(6).cache()


def as_dict(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


PROBS = [0.0, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]


@pytest.fixture
def tight(monkeypatch):
    """Sketches so small, and brackets so few rows wide, that every step of a large table is taken."""
    monkeypatch.setattr(select, "SKETCH", 16)
    monkeypatch.setattr(select, "WHOLE", 20)
    monkeypatch.setattr(select, "SLACK", 0.05)


@pytest.mark.parametrize("held,slack", [(10**9, 0.3), (100, 0.05), (10**9, 1e-4)])
def test_percentiles_are_exact_however_rough_the_sketches(skewed, tight, held, slack):
    """Wide brackets, brackets narrowed round by round, and brackets that miss at first."""
    df = skewed.withColumn("h", (F.col("id") % 3).cast("string"))
    wanted = [select.Wanted(("g", "h"), tuple(PROBS)), select.Wanted(("g",), (0.5, 0.999)), select.Wanted((), (0.1, 0.9))]
    got = select.select(df, ["g", "h"], "v", wanted, [F.count("v").alias("n")], held=held, slack=slack)
    pdf = df.toPandas()
    pdf = pdf[pdf.v.notna()]
    for w in wanted:
        rows = got.percentiles(w).collect()
        groups = pdf.groupby(list(w.keys)) if w.keys else [((), pdf)]
        want = {k if isinstance(k, tuple) else (k,): np.percentile(x.v, [100 * p for p in w.probs]) for k, x in groups}
        assert len(rows) == len(want)
        for r in rows:
            assert np.allclose(r["pct"], want[tuple(r[k] for k in w.keys)]), (w, r)
    assert sum(r.n for r in got.groups.collect()) == len(pdf)


def test_only_rows_inside_a_bracket_are_narrowed(skewed, tight, monkeypatch):
    """The rest is counted without a row per bracket."""
    plans, real = [], select.stored
    monkeypatch.setattr(select, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "brackets" else None) or real(df, name))
    got = select.select(skewed, ["g"], "v", [select.Wanted(("g",), (0.25, 0.5))], held=100, slack=0.05).percentiles()
    pdf = skewed.toPandas()
    assert {r["g"]: r["pct"] for r in got.collect()} == {g: pytest.approx(np.percentile(v.v.dropna(), [25, 50])) for g, v in pdf.groupby("g")}
    lines = plans[0].split("\n")
    per_row = next(i for i, line in enumerate(lines) if "Generate" in line and "_v" in line)
    assert any(("Filter" in line or "Join" in line) and "_hi0" in line and "_hi1" in line for line in lines[per_row + 1:per_row + 5])


def test_percentiles(skewed):
    pdf = skewed.toPandas()
    got = as_dict(select.grouped_percentiles(skewed, ["g"], "v", PROBS), "g")
    assert set(got) == set(pdf[pdf.v.notna()].g)
    for g, row in got.items():
        assert np.allclose(row["pct"], np.percentile(pdf[(pdf.g == g) & pdf.v.notna()].v, [100 * p for p in PROBS]))


def test_a_rising_function_goes_through_the_neighbours(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 4, 9)], "v double")
    w = select.Wanted((), (0.5,))
    assert select.select(df, [], "v", [w]).percentiles(w, through=F.sqrt).first()[0] == [1.5]


def test_global_percentile_null_group_and_no_values(spark, skewed):
    df = skewed.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))
    pdf = df.toPandas()
    assert select.grouped_percentiles(df, [], "v", [0.5]).first()[0] == [pdf.v.median()]
    got = {r["g"]: r["pct"][0] for r in select.grouped_percentiles(df, ["g"], "v", [0.5]).collect()}
    assert got[None] == pytest.approx(pdf[pdf.g.isna()].v.median())
    none = spark.createDataFrame([("x", None), ("y", float("nan")), ("z", 2.0)], "g string, v double")
    rows = {r["g"]: r["pct"] for r in select.stats_with_percentiles(none, ["g"], "v", [F.count("v").alias("n")], [0.5]).collect()}
    assert rows == {"x": None, "y": None, "z": [2.0]}
    assert select.grouped_percentiles(none.limit(0), ["g"], "v", [0.5]).count() == 0


def test_prefix_sum(skewed):
    n = skewed.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    b = order.prefix_sum(n, ["g"], "v", "n", "r", "t").toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    assert (b.groupby("g").n.cumsum() == b.r).all() and (b.groupby("g").n.transform("sum") == b.t).all()


def test_average_rank(skewed):
    got = order.average_rank(skewed, ["g"], "v").toPandas()
    want = got.groupby("g").v.rank(method="average")
    assert np.allclose(got["rank"], want, equal_nan=True) and len(got) == 3000


def test_ranks_of_cells_need_no_join_on_the_value(skewed):
    """One value holds a third of all rows."""
    df = skewed.where("v IS NOT NULL").withColumn("w", F.col("id") % 11)
    cells = df.groupBy("g", "v", "w").agg(F.count("*").alias("n"))
    ranked = order.weighted_ranks(cells, ["g"], "v", "n", "rank")
    got = {(r.g, r.v, r.w): r["rank"] for r in ranked.collect()}
    pdf = df.toPandas()
    want = pdf.groupby("g").v.rank(method="average") - (pdf.groupby("g").v.transform("count") + 1) / 2
    assert all(got[g, v, w] == pytest.approx(x) for g, v, w, x in zip(pdf.g, pdf.v, pdf.w, want))
    p = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in p and all("_bucket" in line for line in p.split("\n") if "Join" in line)


def test_ranges_are_even_and_equal_values_share_one(skewed):
    b = order.ranged(skewed.select("id"), "id").toPandas()
    assert b.groupby("_bucket").id.agg(["min", "max"]).sort_values("min").pipe(lambda t: (t["min"].iloc[1:].to_numpy() > t["max"].iloc[:-1].to_numpy()).all())
    assert b._bucket.nunique() > 4 and b.groupby("_bucket").size().max() < 3000 / 2
    v = order.ranged(skewed.select("v"), "v").toPandas()
    assert (v.groupby("v")._bucket.nunique() == 1).all()


def test_ordinal_and_next(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(50)], "item_id long").repartition(5)
    o = {r["item_id"]: r["ordinal"] for r in order.ordinal(df, "item_id").collect()}
    assert o == {i * 3: i for i in range(50)}
    n = {r["item_id"]: r["next_key"] for r in pairing.next_in_order(df, "item_id").collect()}
    assert n == {i * 3: (i * 3 + 3 if i < 49 else 0) for i in range(50)}


def test_wilcoxon_and_spearman_paths(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, 400).astype(float), rng.integers(0, 30, 400).astype(float)
    df = spark.createDataFrame([("b", float(a), float(b)) for a, b in zip(x, y)], "band string, target double, reference double")
    import pandas as pd

    d = pd.Series(x - y)[x != y]
    ranks = d.abs().rank()
    got = significance.wilcoxon_signed_rank(df, "target", "reference").first()
    assert (got["n"], got["w_plus"], got["w_minus"]) == (len(d), ranks[d > 0].sum(), ranks[d < 0].sum())
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert bands.spearman(df, ["band"], "target", "reference").first()["spearman"] == pytest.approx(want)


def test_correspondence_flags_the_first_best_and_joins_no_values(spark):
    """One value holds half of the rows; the second and third reference bands are equal."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(400) < 0.5, 7.0, rng.normal(size=400))
    rows = [(float(a), float(rng.normal()), float(2 * a), float(2 * a)) for a in x]
    wide = spark.createDataFrame(rows, "s double, other double, same double, again double")
    got = {r.reference: r for r in bands.band_correspondence(wide, ["s"], ["other", "same", "again"]).collect()}
    assert got["same"].is_best and not got["again"].is_best and got["same"].rho == pytest.approx(1) == pytest.approx(got["again"].rho)
    assert abs(got["other"].rho) < 0.2


def test_a_report_runs_only_what_is_asked_for(spark, monkeypatch):
    """Two tables of the sensor report rank four pairs and select one set; all tables take two selections and one ranking."""
    from skydrift.plans import reports

    rng = np.random.default_rng(8)
    wide = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(5, 2, (60, 4))], "a_x double, a_y double, b_x double, b_y double")
    px = wide.select(F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(b).alias("band"), F.col(f"{v}_{b}").alias("value")) for v in "ab" for b in "xy"])))
    chosen, ranked, real, rank = [], [], select.select, bands.rank_correlations
    monkeypatch.setattr(select, "select", lambda df, fine, value, wanted, *x: chosen.append(wanted) or real(df, fine, value, wanted, *x))
    monkeypatch.setattr(bands, "rank_correlations", lambda wide, pairs: ranked.append(pairs) or rank(wide, pairs))
    both = {"x": ("a_x", "b_x"), "y": ("a_y", "b_y")}
    some = reports.sensor_report(px, wide, both, only=["spectral_stats", "transfer"])
    assert list(some) == ["spectral_stats", "transfer"] and chosen == [[bands.TAILS]] and ranked == [[("a_x", "b_x"), ("a_y", "b_y")]]
    every = reports.sensor_report(px, wide, both)
    assert len(chosen) == 3 and len(ranked) == 2 and len(every) == 8
    want = bands.value_histogram(px, ["view"], 60, log=True)
    assert sorted(every["histogram"].collect()) == sorted(want.collect())
    medians = {(r.view, r.band): r.signature for r in every["signature"].collect()}
    assert medians == {(r.view, r.band): pytest.approx(r.signature) for r in bands.spectral_signature(bands.band_stats(px)).collect()}


def test_unique_positions_are_pivoted_where_they_lie(spark):
    wide = spark.createDataFrame([(1, 0, 5.0, 6.0), (1, 1, 7.0, 8.0), (1, 1, 9.0, 9.0), (2, 0, 1.0, None), (2, 1, None, None), (None, 0, 2.0, 4.0)], "k int, y int, a double, b double")
    one = pairing.unique_positions(wide, ["k", "y"])
    assert sorted(map(tuple, one.collect()), key=str) == sorted([(1, 0, 5.0, 6.0), (2, 0, 1.0, None), (2, 1, None, None), (None, 0, 2.0, 4.0)], key=str)
    px = one.select("k", "y", F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.lit("x").alias("band"), F.col(v).alias("value")) for v in "ab"])))
    out = pairing.coregister_pivot(px, ["a", "b"], ["k", "y", "band"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 0, "x", 5.0, 6.0), (None, 0, "x", 2.0, 4.0)], key=str)


def test_the_manifest_report_makes_its_manifest_once(spark):
    from skydrift.plans import reports

    m = spark.range(40).selectExpr("id AS product_id", "cast(id % 32 AS int) AS koppen_zone", "if(id % 5 = 0, 'test', 'train') AS split", "date'2020-01-01' AS date_phi")
    t = reports.dataset_report(m, [], [10], ["climate", "months", "leakage"])
    assert list(t) == ["months", "climate", "leakage"]
    assert all("Range" not in df._jdf.queryExecution().optimizedPlan().toString() and "/manifest-" in df.inputFiles()[0] for df in t.values())
    assert t["leakage"].first().total == 8


def test_per_image_results_move_pixels_once(spark):
    """Wide and long forms agree, with nulls, NaN, zeros and an empty band; one exchange carries the pixels' columns."""
    data = [(i % 7, None if i % 11 == 0 else float(i), float("nan") if i % 13 == 0 else i * 2.0, 0.0 if i % 7 == 3 else i + 0.5, None if i % 7 == 2 else i * 3.0) for i in range(200)]
    wide = spark.createDataFrame(data, "k int, a_x double, a_y double, b_x double, b_y double").withColumn("a_z", F.lit(0.0)).withColumn("b_z", F.lit(None).cast("double"))
    columns = {(v, b): f"{v}_{b}" for v in "ab" for b in "xyz"}
    cells = F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(b).alias("band"), F.col(c).alias("value")) for (v, b), c in columns.items()]))
    px, pairs = wide.select("k", cells), {b: (f"a_{b}", f"b_{b}") for b in "xyz"}
    table = lambda df, n: {tuple(r[:n]): pytest.approx(tuple(r[n:])) for r in df.collect()}
    got = bands.image_stats(wide, ["k"], columns)
    assert {k: tuple(v.expected) for k, v in table(got, 3).items()} == table(bands.band_stats(px, ["k", "view"], expected=px, bounded_groups=True), 3)
    drift = bands.spectral_drift_columns(wide, ["k"], pairs)
    assert {k: tuple(v.expected) for k, v in table(drift, 2).items()} == table(bands.spectral_drift_wide(px, ["k", "band"], "a", "b"), 2)
    whole = bands.spectral_drift_columns(wide, [], pairs)
    assert {k: tuple(v.expected) for k, v in table(whole, 1).items()} == table(bands.spectral_drift_wide(px, ["band"], "a", "b"), 1)
    for df in (got, drift, bands.spectral_drift_summary(drift, ["k"])):
        assert df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_columns_are_ranked_once_for_all_pairs(spark, monkeypatch):
    """Nulls in one column, half of the rows one value, few and many values; each column is ranked once, only mismatched pairs by themselves."""
    import pandas as pd

    rng = np.random.default_rng(4)
    t = pd.DataFrame({"a": np.where(rng.random(500) < 0.5, 7.0, rng.normal(size=500)), "b": rng.integers(0, 5, 500) * 1.0, "c": rng.normal(size=500)})
    t["d"], t["e"] = t.a + t.c, np.where(rng.random(500) < 0.2, np.nan, t.b + t.c)
    wide = spark.createDataFrame([tuple(None if x != x else x for x in map(float, r)) for r in t.to_numpy()], "a double, b double, c double, d double, e double")
    pairs, calls, real = [(x, y) for x in "ab" for y in "cde"], [], order.weighted_ranks
    monkeypatch.setattr(order, "weighted_ranks", lambda *x: calls.append(x) or real(*x))
    for limit in (order.BROADCAST_ROWS, 10):  # ranks broadcast, and joined
        monkeypatch.setattr(order, "BROADCAST_ROWS", limit)
        for some in (pairs, [p for p in pairs if "e" not in p]):
            calls.clear()
            got = {(r.x, r.y): r.spearman for r in bands.rank_correlations(wide.unionAll(wide), some).collect()}
            assert got == {(x, y): pytest.approx(t[[x, y]].dropna().rank().corr().iloc[0, 1]) for x, y in some}
            assert len(calls) == (3 if some is pairs else 1)
    fit = {r.band: r for r in bands.sensor_transfer_fit_wide(wide, {"one": ("a", "d"), "two": ("b", "c")}).collect()}
    assert fit["one"].spearman == pytest.approx(t[["a", "d"]].rank().corr().iloc[0, 1]) and fit["one"].pearson == pytest.approx(t[["a", "d"]].corr().iloc[0, 1])
    assert fit["two"].slope == pytest.approx(np.polyfit(t.b, t.c, 1)[0])
    assert bands.rank_correlations(wide.limit(0), pairs).count() == 0


@pytest.fixture(scope="module")
def two_sets(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(70, 6)), rng.normal(size=(70, 6)) * 1.3 + 0.4
    mk = lambda m: spark.createDataFrame([(i, i // 50, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, batch long, embedding array<double>")
    return a, b, embedding.two_sample(mk(a), mk(b)), mk(a), mk(b)


def brute(a, b, kern):
    d = lambda x, y: ((x[:, None] - y[None]) ** 2).sum(-1)
    return kern(d(a, a)), kern(d(b, b)), kern(d(a, b))


def test_mmd_blocks_equal_brute_force(two_sets):
    a, b, z, _, _ = two_sets
    for block in (8, 1000):
        got = {r["batch"]: r for r in embedding.mmd2_biased(z, block=block).collect()}
        uns = {r["batch"]: r for r in embedding.mmd2_unbiased(z, block=block).collect()}
        mean = {r["batch"]: r for r in embedding.mmd_mean_bandwidth(z, block=block).collect()}
        for k, rows in {0: slice(0, 50), 1: slice(50, 70)}.items():
            x, y = a[rows], b[rows]
            n = len(x)
            kern = lambda d: sum(np.exp(-d / (2 * s * s)) for s in (1, 2, 4, 8, 16)) / 5
            kaa, kbb, kab = brute(x, y, kern)
            assert got[k]["mmd2"] == pytest.approx(max(kaa.mean() + kbb.mean() - 2 * kab.mean(), 0), abs=1e-10)
            pooled = np.vstack([x, y])
            d = ((pooled[:, None] - pooled[None]) ** 2).sum(-1)
            off = np.sort(d[~np.eye(2 * n, dtype=bool)])
            med = off[(len(off) - 1) // 2]
            assert uns[k]["bandwidth"] == pytest.approx(med, rel=1e-9)
            kaa, kbb, kab = brute(x, y, lambda q: np.exp(-q / med))  # noqa: B023
            want = (kaa.sum() - n) / (n * (n - 1)) + (kbb.sum() - n) / (n * (n - 1)) - 2 * kab.mean()
            assert uns[k]["mmd2"] == pytest.approx(want, abs=1e-9)
            bw = off.mean()
            assert mean[k]["bandwidth"] == pytest.approx(bw)
            kaa, kbb, kab = brute(x, y, lambda q: sum(np.exp(-q / (bw / 4 * 2**i)) for i in range(5)))  # noqa: B023
            assert mean[k]["mmd"] == pytest.approx((kaa + kbb - 2 * kab).mean(), abs=1e-9)


@pytest.mark.parametrize("bandwidth", [None, 12.0])
def test_whole_set_mmd_is_within_its_error(spark, two_sets, bandwidth):
    """Sets of unequal size, a row without a vector, a set of one row."""
    a, b, z, _, _ = two_sets
    z = z.where("side = 'a' OR batch = 0").withColumn("batch", F.lit(0).cast("long"))
    lone = z.where("item = 'a3'").withColumn("batch", F.lit(5).cast("long"))
    none = lone.withColumns({"embedding": F.lit(None).cast("array<double>"), "item": F.lit("zz"), "batch": F.lit(0).cast("long")})
    rows = {r.batch: r for r in distance.mmd2_whole(z.unionByName(none).unionByName(lone) if bandwidth else z.unionByName(none), 6, bandwidth).collect()}
    pooled = np.vstack([a, b[:50]])
    d = ((pooled[:, None] - pooled[None]) ** 2).sum(-1)
    off = np.sort(d[~np.eye(len(pooled), dtype=bool)])
    bw = bandwidth or off[(len(off) - 1) // 2]
    kaa, kbb, kab = brute(a, b[:50], lambda q: np.exp(-q / bw))
    want = (kaa.sum() - 70) / (70 * 69) + (kbb.sum() - 50) / (50 * 49) - 2 * kab.mean()
    got = rows[0]
    assert got.bandwidth == pytest.approx(bw) and (got.n, got.m) == (70, 50)
    assert abs(got.mmd2 - want) <= 4 * got.std_error and got.std_error < 0.02
    assert bandwidth is None or (rows[5].n, rows[5].m, rows[5].mmd2) == (1, 0, None)


def test_median_of_drawn_pairs_has_the_rank_error_of_its_sample(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((700, 3)), 5 + rng.standard_normal((500, 3))])
    z = spark.createDataFrame([(0, f"{'ab'[i % 2]}{i}", "ab"[i % 2], [float(t) for t in v]) for i, v in enumerate(x)], "batch long, item string, side string, embedding array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
    for pairs in (1_000_000, 20_000):
        got = distance.pooled_median_sq_distance(z, pairs).first()["bandwidth"]
        assert abs((d <= got).mean() - 0.5) < (1e-5 if pairs > len(d) else 4 * 0.5 / np.sqrt(pairs))


def test_retrieval_blocks(two_sets):
    a, b, _, da, db = two_sets
    pairs = da.withColumnRenamed("embedding", "emb_a").join(db.select("item_id", F.col("embedding").alias("emb_b")), "item_id").withColumn("batch", F.lit(0).cast("long"))
    u, v = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    want = ((u @ v.T).argmax(1) == np.arange(70)).mean()
    for block in (9, 1000):
        assert embedding.retrieval_top1(pairs, block=block).first()["retrieval_top1"] == pytest.approx(want)
    al = embedding.alignment_metrics(pairs).first()
    s = u @ v.T
    assert al["cos_paired"] == pytest.approx(np.diag(s).mean())
    assert al["cos_unpaired"] == pytest.approx((s.sum() - np.trace(s)) / (70 * 69))


def test_split_sizes_are_exact_and_disjoint(skewed):
    s = splits.random_split(skewed.select("id"), ["id"])
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 2400, "val": 300, "test": 300} and s.select("id").distinct().count() == 3000


def test_permuted_labels_keep_their_counts(skewed):
    p = splits.permute_labels(skewed.select("id", "g"), "id", "g").cache()
    before = {r["g"]: r["count"] for r in p.groupBy("g").count().collect()}
    after = {r["permuted"]: r["count"] for r in p.groupBy("permuted").count().collect()}
    assert before == after and p.where("g <> permuted").count() > 0


def test_lowest_per_group(skewed):
    two = skewed.withColumn("c", F.when(F.col("g") == "g0", 0).otherwise(1))
    ids = [{r["id"] for r in splits.balanced_sample(two, "c", 40, ["id"], digits=d).collect()} for d in (1, 4)]
    assert ids[0] == ids[1] and len(ids[0]) == 80
    px = skewed.select(F.col("g").alias("patch_index"), F.col("id").alias("y"), F.lit(0).alias("x"))
    per = splits.sample_pixels(px, 5).groupBy("patch_index").count().collect()
    assert all(r["count"] == 5 for r in per)


def test_sample_n_is_exact_and_follows_the_digest(skewed):
    import hashlib

    ids = skewed.select("id")
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (0, 1, 700, 2999, 3000, 5000):
        assert [r.id for r in splits.sample_n(ids, n, ["id"]).collect()] == sorted(want[:n])


def test_group_split_cuts_are_not_rounded(spark):
    groups = spark.range(200_000).select(F.col("id").alias("g"))
    n = {r.split: r["count"] for r in splits.group_split(groups, "g", cuts=(0.00004, 0.5)).groupBy("split").count().collect()}
    assert 0 < n["train"] < 30 and abs(n["val"] - 100_000) < 1500


ROUGH = ["band_stats", "box_stats", "box_stats_standardised", "percentile_stretch", "domain_stats", "value_histogram_log", "value_histogram_per_band", "manifest_summary"]


@pytest.mark.parametrize("name", ROUGH)
def test_queries_match_sql_with_rough_sketches(spark, sf, name, tight):
    import oracle

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf).toPandas()
    assert oracle.compare(got, oracle.connect(sf).execute(entry.oracle_sql()[name]).df()) is None


def test_group_tables_are_broadcast_only_when_few(spark, skewed, monkeypatch):
    m = skewed.groupBy("g").agg(F.max("v").alias("m"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(order.join_group_stats(skewed, m, ["g"]))
    monkeypatch.setattr(order, "BROADCAST_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = order.join_group_stats(skewed, m, ["g"])
        assert "SortMergeJoin" in plan(beyond) and beyond.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
