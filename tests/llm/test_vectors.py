"""Operators on vectors against brute force, with nulls, ties, copies, hot groups, ragged and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.llm.hard_negatives import Lists, hard_negatives, top, top_in_windows
from skydrift.llm.vector_codes import Grid, label_errors, vector_codes
from skydrift.llm.vector_dedup import collision_chance, near_duplicate_vectors, number_of_lists, required_count, tail_start

SCHEMA = "vec_id long, embedding array<float>, label int, node long, key string, row long, id string, q int, v int, block int, copies int"
EXTRA = (1, "k", 2, "i", 3, 4, 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, *EXTRA) for i, v, label in rows], SCHEMA).repartition(3)


def unit(rng, n, d=16):
    x = rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


ODD = [(9001, None, 1), (9002, [None] * 16, 2), (9003, [math.nan] * 16, 3), (9004, [math.inf] + [0] * 15, 1), (9005, [], 1), (9006, [0] * 16, 1)]


def clean(rows):
    return [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]


# ---- hard negatives


def brute_negatives(rows, every):
    rows = list({(i, label, tuple(v)): (i, np.floor(256 * v).astype(int), label) for i, v, label in clean(rows) if i is not None and label is not None}.values())
    out = []
    for i, a, own in rows:
        if i % every:
            continue
        s = [(-int(a @ v), j, label) for j, v, label in rows if not (j == i and label == own and (v == a).all())]
        for p, j, _ in sorted(x for x in s if x[2] == own)[:5]:
            held = sorted(x for x in s if x[2] != own and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, j, k + 1, h[1], -p, -h[0]) for k, h in enumerate(held)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(4)
    x = unit(rng, 400)
    x[100:140] = x[7]  # ties: many equal rows of several labels
    x[200:260] = x[50] + 0.05 * rng.standard_normal((60, 16))
    rows = [(i, v, int(rng.integers(0, 4)) if i % 3 else 0) for i, v in enumerate(x)]
    return [*rows, rows[50], rows[50], (50, x[51], 1), (60, x[9], None), (None, x[10], 1), *ODD]


@pytest.mark.parametrize("blocks", [(10_000, 1024), (60, 7)])
def test_negatives_match_brute_force(spark, labelled, blocks):
    got = hard_negatives(frame(spark, labelled), F.col("vec_id") % 10 == 0, block_rows=blocks[0], group_anchors=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_negatives(labelled, 10)


def test_negatives_of_little(spark, labelled):
    every = F.col("vec_id") % 10 == 0
    assert hard_negatives(frame(spark, labelled).limit(0), every).count() == 0
    assert hard_negatives(frame(spark, ODD), every).count() == 0
    assert hard_negatives(frame(spark, labelled), F.lit(None).cast("boolean")).count() == 0
    ragged = [(10, [1, 2], 1), (20, [1, 2, 0], 1), (30, [1, 1.5], 2), (40, [-1], 2)]
    want = brute_negatives([(i, [*v, 0, 0][:3], label) for i, v, label in ragged], 10)
    assert want and sorted(map(tuple, hard_negatives(frame(spark, ragged), every).collect())) == want


def test_reading_stops_before_the_whole_block():
    """One direction stands out: the rows that matter are on top of its list."""
    rng = np.random.default_rng(1)
    values = rng.integers(-20, 20, (5000, 8)).astype(float)
    values[:40, 0] = 4000 - np.arange(40)
    lists = Lists(np.arange(5000), np.arange(5000), values)
    anchor = np.array([200.0, 1, -1, 2, 0, 0, 1, 1])
    met = []
    read = lists.seen
    lists.seen = lambda a, enough: met.append(read(a, enough)) or met[-1]
    places, scores = top(lists, anchor, -1, 5)
    true = values @ anchor
    assert scores.tolist() == np.sort(true)[::-1][:5].tolist() and len(met[0][0]) < 2000
    found = top_in_windows(lists, np.ones(5000, bool), anchor, [int(true.max())], 3, 50, 95)
    inside = [x for x in np.sort(true)[::-1] if 50 * true.max() <= 100 * x <= 95 * true.max()]
    assert found[int(true.max())][1].tolist() == inside[:3]


def test_strict_threshold_finds_the_tie_with_the_smaller_id():
    """Three equal scores: the one met last has the smallest id."""
    values = np.array([[9.0, 0], [9, 0], [0, 9], *[[-5, -5]] * 60])
    lists = Lists(np.array([3, 2, 1, *range(100, 160)]), np.arange(63), values)
    places, _ = top(lists, np.array([1.0, 1.0]), -1, 1)
    assert lists.ids[places].tolist() == [1]


# ---- codes


def brute_codes(rows, n_entries, rounds=4):
    kept = sorted(((i, np.floor(1024 * v).astype(np.int64), label) for i, v, label in clean(rows) if len(v) == 16), key=lambda r: (r[0] is None, r[0] or 0, tuple(r[1])))
    x = np.stack([r[1] for r in kept])
    books = [x[:n_entries, p * 4:p * 4 + 4].copy() for p in range(4)]
    for k in range(rounds + 1):
        d = [((x[:, None, p * 4:p * 4 + 4] - b[None]) ** 2).sum(2) for p, b in enumerate(books)]
        at = [m.argmin(1) for m in d]
        if k < rounds:
            books = [np.stack([x[a == e, p * 4:p * 4 + 4].sum(0) // (a == e).sum() if (a == e).any() else b[e] for e in range(len(b))]) for p, (a, b) in enumerate(zip(at, books))]
    error = sum(m.min(1) for m in d)
    labels = {}
    for r, e in zip(kept, error):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    return sorted([(r[0], [int(a[j]) for a in at], int(error[j]), labels[r[2]]) for j, r in enumerate(kept)], key=key), books


@pytest.mark.parametrize("n_entries", [5, 32, 1000])
def test_codes_match_brute_force(spark, labelled, n_entries):
    rows = [*labelled, (9100, [1.0] * 8, 1)]  # a shorter vector is not coded
    coded, books = vector_codes(frame(spark, rows), n_entries=n_entries, carry=["label"])
    want, expected = brute_codes(rows, n_entries)
    assert all((a == b).all() for a, b in zip(books, expected))
    got = [(r.vec_id, list(r.code), r.error, r.label_error) for r in label_errors(coded).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])) == want


def test_codes_of_little(spark, labelled):
    for rows in (labelled[:1], ODD[:5]):
        coded, books = vector_codes(frame(spark, rows))
        assert coded.count() == len(clean(rows)) == len(books[:1])
    coded, books = vector_codes(frame(spark, labelled).limit(0), carry=["label"])
    assert label_errors(coded).count() == 0 and books == []
    with pytest.raises(ValueError, match="4 equal parts"):
        vector_codes(frame(spark, [(1, [1, 2, 3], 1)]))


def test_cells_leave_every_nearest_entry_and_drop_others():
    rng = np.random.default_rng(2)
    entries = np.concatenate([rng.integers(-40, 40, (30, 4)), rng.integers(900, 1000, (30, 4))])
    grid = Grid(entries)
    x = np.concatenate([rng.integers(-60, 60, (500, 4)), rng.integers(800, 1100, (500, 4)), entries])
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    for _ in range(2):  # the second time from memory
        index, error = grid.nearest(x)
        assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
    left = grid.left(np.unique(x >> grid.shift, axis=0))
    assert left.mean() < 0.7 and len(grid.memo) == len(left)


# ---- near duplicates


def brute_links(rows, threshold=0.95):
    rows = list(rows)
    use = [j for j, (_, v, _) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.stack([np.array(rows[j][1], float) for j in use])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([math.inf if rows[j][0] is None else rows[j][0] for j in use])
    while True:
        new = np.array([min([label[j], *label[near[j]]]) for j in range(len(use))])
        if (new == label).all():
            break
        label = new
    n, to = dict(zip(use, near.sum(1))), dict(zip(use, label))
    return [(i, int(n.get(j, 0)), i if j not in to or to[j] == math.inf else int(to[j])) for j, (i, _, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def near():
    """Copies, pairs just over and under the threshold, and a group that holds a third of all rows."""
    rng = np.random.default_rng(3)
    x = list(unit(rng, 500, 64))
    for c in (0.951, 0.96, 0.97, 0.99, 0.949, 0.94):
        for _ in range(60):
            a = unit(rng, 1, 64)[0]
            b = unit(rng, 1, 64)[0]
            b = b - (a @ b) * a
            x += [a, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).astype(np.float32)]
    centre = unit(rng, 1, 64)[0]
    x += list((centre + 0.018 * rng.standard_normal((600, 64))).astype(np.float32))
    x += [x[0], x[0], 3 * x[0], *[x[5]] * 40]
    order = rng.permutation(len(x))
    pad = [(i, v if v is None or len(v) != 16 else [*v, *[0] * 48], label) for i, v, label in ODD]
    return [*[(int(i), v, 1) for i, v in zip(order, x)], (None, x[1], 1), (None, x[2] * 2, 1), (3, x[3], None), *pad]


@pytest.mark.parametrize("block_rows", [1024, 100])
def test_vector_links_match_brute_force(spark, near, block_rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2])
    got = near_duplicate_vectors(frame(spark, near), block_rows=block_rows).collect()
    want = brute_links(near)
    assert len(got) == len(want)
    a, b = (sorted(x, key=key) for x in ([(r.vec_id, r.n_links, r.component_id) for r in got], want))
    found, there = (sum(r[1] for r in x) for x in (a, b))
    assert 0.995 * there <= found <= there
    assert np.mean([x == y for x, y in zip(a, b)]) >= 0.97
    assert all(r.kept == (r.vec_id == r.component_id or r.component_id is None) for r in got)


def test_no_pair_of_a_group_is_counted_twice(spark, near):
    group = [r for r in brute_links(near) if r[1] >= 500]
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(frame(spark, near), block_rows=64).collect()}
    assert len(group) >= 500 and all(0.99 * n <= got[i] <= n for i, n, _ in group)


def test_vector_links_of_little(spark, near):
    assert near_duplicate_vectors(frame(spark, near).limit(0)).count() == 0
    got = near_duplicate_vectors(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got)
    ragged = [(1, [1, 1], 1), (2, [2, 2, 0], 1), (3, [1], 1), (4, [1e-30], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(frame(spark, ragged)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def test_count_is_set_from_the_chance_of_a_collision():
    """Against draws: correlated normal pairs fall into one tail and window as often as computed."""
    rng = np.random.default_rng(0)
    tail = tail_start(0.02)
    t = rng.standard_normal(4_000_000)
    u = 0.95 * t + math.sqrt(1 - 0.95**2) * rng.standard_normal(len(t))
    drawn = ((np.abs(t) >= tail) & (np.abs(u) >= tail) & (np.abs(t - u) <= 0.3)).mean()
    assert abs(collision_chance(0.95, tail, 0.3) / drawn - 1) < 0.03
    assert required_count(1000, 0.012, 0.998) == max(k for k in range(30) if sum(math.comb(1000, j) * 0.012**j * 0.988 ** (1000 - j) for j in range(k)) <= 0.002)
    assert number_of_lists(1) == 512 and number_of_lists(4 * 10**8) == 2 * number_of_lists(10**8)


def test_queries_match_their_sql_on_copies(spark, near, tmp_path):
    """The registered queries' SQL, on a table that has links."""
    import duckdb

    from skydrift.llm import catalog

    rows = [r for r in near if r[0] is not None and r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = list({r[0]: r for r in rows}.values())
    frame(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, least in (("op11_hard_negatives", 1.0), ("op12_vector_codes", 1.0), ("op13_vector_dedup", 0.97)):
        want = con.execute(catalog.ORACLE[name]).df()
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
        a, b = (sorted(map(tuple, x.astype(object).to_numpy().tolist())) for x in (got, want))
        assert len(a) == len(b) and np.mean([x == y for x, y in zip(a, b)]) >= least, name
