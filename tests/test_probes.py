"""The stacked fits end at the optimum of the stated objective, whatever the number of problems and partitions."""

import numpy as np
import pytest

from skydrift.operators import linear, probes

FOLDS = 5


@pytest.fixture(scope="module")
def table(spark):
    """Three sources, one far from the others, one with a constant component; a few items with coin-flip labels."""
    rng = np.random.default_rng(8)
    x = {"a": rng.standard_normal((90, 4)), "b": rng.standard_normal((70, 4)) + 0.6, "far": rng.standard_normal((80, 4)) * 0.3 + [9, -4, 0, 2]}
    for v in x.values():
        v[:, 2] = 1.5
    rows = [(s, i % FOLDS, float(rng.integers(0, 2)), [float(t) for t in v], i) for s, vs in x.items() for i, v in enumerate(vs)]
    return rows, spark.createDataFrame(rows, "source string, fold int, label double, x array<double>, item_id long").repartition(7)


PROBLEMS = [linear.Problem("a|b", {"a": 0.0, "b": 1.0}), linear.Problem("a|far", {"a": 0.0, "far": 1.0}), linear.Problem("coin", {"a": None, "b": None})]


def slope(rows, problem, probe, k, loss):
    """Gradient of the objective at the weights, row by row."""
    use = [(x, label if problem.sources[s] is None else problem.sources[s]) for s, fold, label, x, _ in rows if s in problem.sources and fold != k]
    w = probe.weights[k]
    g = w.copy()
    if loss == "logistic":
        g[-1] = 0.0
    for x, y in use:
        d = np.append((np.array(x) - probe.shift) / probe.scale, 1.0)
        z = float(d @ w)
        g = g + (1 / (1 + np.exp(-z)) - y) * d if loss == "logistic" else g - 2 * (2 * y - 1) * max(1 - (2 * y - 1) * z, 0) * d
    return np.abs(g).max() / len(use)


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("scale", ["none", "pooled"])
def test_every_fold_ends_at_its_optimum(table, loss, scale):
    rows, df = table
    fitted = linear.fit(df, PROBLEMS, loss, FOLDS, scale)
    for p in PROBLEMS:
        assert fitted[p.name].gradient <= 1e-8
        assert all(slope(rows, p, fitted[p.name], k, loss) < 1e-7 for k in range(FOLDS))
    if scale == "pooled":
        both = np.array([r[3] for r in rows if r[0] in ("a", "b")])
        assert np.allclose(fitted["a|b"].shift, both.mean(0)) and np.allclose(fitted["a|b"].scale, [*both.std(0)[:2], 1.0, both.std(0)[3]])


def test_stacked_equals_alone_and_any_partitioning(table):
    _, df = table
    together = linear.fit(df, PROBLEMS, folds=FOLDS)
    for p in PROBLEMS:
        assert np.allclose(linear.fit(df.coalesce(1), [p], folds=FOLDS)[p.name].weights, together[p.name].weights, atol=1e-6)


def test_held_out_scores_use_the_fold_that_did_not_see_the_row(table):
    rows, df = table
    fitted = linear.fit(df, PROBLEMS, folds=FOLDS)
    got = {(r.name, r.source, r.item_id): (r.label, r.score) for r in linear.held_out(df, PROBLEMS, fitted, ["item_id"]).collect()}
    assert len(got) == 160 + 170 + 160
    for s, fold, label, x, i in rows:
        for p in PROBLEMS:
            if s in p.sources:
                y, score = got[p.name, s, i]
                assert score == pytest.approx(np.append(x, 1.0) @ fitted[p.name].weights[fold])
                assert y == (label if p.sources[s] is None else p.sources[s])


def test_unreached_optimum_raises(table):
    _, df = table
    with pytest.raises(RuntimeError, match="no optimum"):
        linear.fit(df, PROBLEMS, max_steps=1)
    with pytest.raises(ValueError, match="no loss"):
        linear.fit(df, PROBLEMS, "hinge")
    with pytest.raises(ValueError, match="none of its sources"):
        linear.fit(df, [linear.Problem("x", {"nowhere": 1.0})])


def test_ladder_has_every_rung_and_layer(spark):
    rng = np.random.default_rng(5)
    clean = rng.standard_normal((120, 2, 6))
    rows = []
    for v, shift in (("clean", 0.0), ("snr_l1", 0.0), ("snr_l2", 4.0)):
        for i in range(120):
            for k in range(2):
                x = clean[i, k] + (shift if k else 0.0) + (rng.standard_normal(6) * 0.1 if v != "clean" else 0)
                rows.append((i, v, k, [float(t) for t in x]))
    df = spark.createDataFrame(rows, "item_id long, variant string, layer int, embedding array<double>")
    labels = spark.createDataFrame([(i, int(clean[i, 1, 0] > 0)) for i in range(120)], "item_id long, label int")
    got = {r.variant: r for r in probes.factor_response(df, labels, ["snr_l1", "snr_l2"]).collect()}
    assert set(got) == {"snr_l1", "snr_l2"} and all(len(r.layer_cosines) == len(r.layer_pads) == 2 and r.gradient <= 1e-8 for r in got.values())
    assert got["snr_l2"].pad == pytest.approx(2, abs=0.05) and got["snr_l2"].layer_pads[0] < 0.5 and got["snr_l1"].pad < 0.6
    assert got["snr_l1"].probe_clean == got["snr_l2"].probe_clean and got["snr_l1"].retention > 0.9 > got["snr_l2"].retention
    per = probes.layer_distances(df.where("variant = 'clean'"), df.where("variant = 'snr_l2'")).orderBy("layer").collect()
    assert [r.layer for r in per] == [0, 1] and per[1].pad > 1.9
