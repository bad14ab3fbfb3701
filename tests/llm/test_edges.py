"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.llm import catalog
from skydrift.llm.components import components
from skydrift.llm.decontaminate import decontaminate
from skydrift.llm.line_dedup import line_dedup
from skydrift.llm.lm_score import Attention, lm_scores
from skydrift.llm.near_dedup import Items, Weights, WordHash, near_duplicates
from skydrift.llm.packing import best_pattern, cutting_stock, pack, sequences
from skydrift.llm.pii import base_spans, personal_data
from skydrift.llm.quality import binomial_tail, quality_rules
from skydrift.llm.substring_dedup import repeated_substrings
from skydrift.llm.toxicity import toxicity
from skydrift.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, id string, row int, node string, word string, label int, size int, rank int, spans string, m int, h int"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
SHARED = " ".join(f"bench{i}" for i in range(12))
TEXTS = [
    (None, None, "en"), (1, "", None), (2, "  \n\t ", "en"), (3, LONG, "en"), (4, LONG, "en"), (4, LONG, "en"), (5, LONG + " tail", None), (5, "other text under the same id, mailto a.b@c.org", "fr"),
    (6, "Éa ça   \x00 naïve\nÉa ça   \x00 naïve", "fr"), (7, f"start {SHARED} stop", "en"), (8, "a " * 5000, "en"), (9, "x" * 20000, "en"), (10, None, "de"),
    *[(20 + i, f"This line is held by several documents\nonly {i} here", "en") for i in range(4)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "x", 1, "n", "w", 2, 3, 4, "s", 5, 6) for t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (20, 1, 0), (21, 1, 1), (22, 0, 1), (23, 1, 0)], "doc_id long, quality int, toxic int")


def texts(rows):
    return sorted((repr(i), t or "") for i, t, _ in rows)


def test_line_dedup(docs, none):
    out = line_dedup(docs).collect()
    assert len(out) == len(TEXTS) and line_dedup(none).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[None].n_lines == 1 and by[1].kept_text == "" and by[23].n_dropped == 0
    assert all(by[i].kept_text == f"only {i - 20} here" for i in (20, 21, 22))
    assert by[3].n_dropped == by[4].n_dropped == 0  # three rows hold the line, but only two documents


def test_line_dedup_counts_documents_as_its_sql_does(spark):
    """Rows that repeat an id are one document; the same rows through the registered SQL."""
    import duckdb

    line, other = "a line of more than twenty characters", "another line of more than twenty"
    data = [(1, f"{line}\nfirst"), (2, line), (2, line), (3, f"{other}\n{other}"), (4, other.upper()), (5, f"  {other}\t"), (5, f"{other}\nx"), (6, None), (7, "")]
    documents = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = documents.transform(line_dedup)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
    con = duckdb.connect()
    # the SQL has one row per id, so rows of an id come under ids of their own that stay together in the count
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, "\n".join(t or "" for j, t in data if j == i)) for i in sorted({d[0] for d in data})])
    dropped = {r[0]: r[2] for r in con.execute(catalog.LINE_DEDUP_SQL).fetchall()}
    by = Counter()
    for (i, _, n, _), k in got.items():
        by[i] += n * k
    assert dict(by) == dropped and dropped[1] == 0 and dropped[3] == 2 and dropped[4] == 1 and dropped[5] == 0


def test_quality_counts(docs, none, labels):
    out = quality_rules(docs, labels).collect()
    assert len(out) == len(TEXTS) and quality_rules(none, labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == len(TEXTS)
    want = Counter()
    for i, t, _ in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(n, k, p) for n in (1, 20, 400) for k in (0, 1, 7) for p in (0.01, 0.2) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long, p double").select("n", "k", "p", binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("t")).collect()
    for r in rows:
        assert abs(r.t - sum(comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k + 1))) < 1e-9


def test_cutoffs_hold_their_guarantee(spark):
    """Good documents must not lose more than the stated share; plainly bad ones go."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join(word() + ("###" if i % 10 == 9 else "") for _ in range(60)), "en") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i % 10 != 9)) for i in range(4000)], "doc_id long, quality int")
    out = quality_rules(d, marks, max_rejection=0.06, delta=0.2).collect()
    good = [r.kept for r in out if r.doc_id % 10 != 9]
    assert sum(good) >= 0.94 * len(good) and not any(r.kept for r in out if r.doc_id % 10 == 9)


def test_near_duplicates(docs, none):
    out = near_duplicates(docs).collect()
    assert len(out) == len(TEXTS) and near_duplicates(none).count() == 0
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.class_id)
    assert by[3] == by[4] == {3} and 3 in by[5] and by[None] == {None} and by[1] == {1} and by[2] == {2}
    assert near_duplicates(docs).where("stays").select("class_id").distinct().count() == len({r.class_id for r in out})


def test_near_duplicates_against_all_pairs(spark, sf):
    rows = {r.doc_id: r.class_id for r in catalog.QUERIES["op2_near_dedup"](spark, sf).collect()}
    sets = {}
    for r in catalog.table(spark, sf, "documents").collect():
        w = (r.text or "").encode().split()
        sets[r.doc_id] = Counter(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = sum((sets[a] & sets[b]).values())
        if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert rows == {i: top(i) for i in sets}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 102), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_packing_round_trip(docs, none):
    packed = pack(docs, catalog.tokenizer_file("word_bpe_49k.json"), with_ids=True).cache()
    assert pack(none, catalog.tokenizer_file("word_bpe_49k.json")).count() == 0
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.tokenizer_file("word_bpe_49k.json"))
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in TEXTS)
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, tuple(r.ids)))
    for (i, ids), n in want.items():
        got = Counter(pieces[(i, len(ids))])
        assert sum(k * len(x[1]) for x, k in got.items()) % len(ids) == 0
        at = 0
        while at < len(ids):
            part = next(x for x in got if x[0] == at and ids[at : at + len(x[1])] == x[1])
            assert got[part] >= n
            at += len(part[1])
    for r in sequences(packed).collect():
        assert 0 < len(r.ids) <= 4096
    offsets = defaultdict(list)
    for r in packed.collect():
        offsets[r.sequence_id].append((r.offset, r.length))
    for parts in offsets.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(5)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 40, 64)
    use = demand > 0
    plan = cutting_stock(sizes[use], demand[use], 64)
    assert all((a * sizes[use]).sum() <= 64 for a, _ in plan)
    assert (sum(a * n for a, n in plan) >= demand[use]).all()
    rooms: list[int] = []  # first fit, largest first, is never to be beaten by much
    for size in np.repeat(sizes, demand)[::-1]:
        at = next((i for i, r in enumerate(rooms) if r >= size), None)
        if at is None:
            rooms.append(64 - size)
        else:
            rooms[at] -= size
    assert sum(n for _, n in plan) <= len(rooms) + 3
    assert (best_pattern(np.array([3, 5]), np.array([1.0, 1.9]), 11) * [3, 5]).sum() <= 11


def test_substrings(docs, none):
    out = repeated_substrings(docs).collect()
    assert len(out) == len(TEXTS) and repeated_substrings(none).count() == 0
    words = [(t or "").encode().split() for _, t, _ in TEXTS]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (i, _, _), w in zip(TEXTS, words):
        gone = {j for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, SHARED, 0), (2, "under the same", 0), (3, None, 0), (4, "", 0), (None, "bench0 bench1", 0), (1, SHARED, 0)], "item_id int, text string, size int")
    out = {(r.doc_id, r.n_words): r for r in decontaminate(docs, items).collect()}
    assert out[(7, 14)].n_hit == 12 and out[(7, 14)].items == ["1"]
    assert [r.items for r in out.values() if r.doc_id == 5 and r.n_words < 100] == [["2"]]
    assert sum(r.contaminated for r in out.values()) == 2
    assert decontaminate(none, items).count() == 0 and decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_personal_data(docs, none):
    out = personal_data(docs).collect()
    assert len(out) == len(TEXTS) and personal_data(none).count() == 0
    assert [[(s.kind, s.end - s.start) for s in r.base] for r in out if r.base] == [[("email", 9)]]


@pytest.mark.parametrize("text,want", [
    ("a@b.c, x@y", [(0, 0, 5)]), ("1.2.3.4.5.6.7.8", [(0, 1, 7), (8, 1, 15)]), ("1.2.3.256", []), ("4111 1111-1111 1111", [(0, 2, 19)]), ("+1 (988) 555-2485 x", [(0, 3, 17)]), ("+12", []), ("é a@b.c@d.e", [(2, 0, 7), ]),
])
def test_patterns(text, want):
    assert base_spans(text) == want


def test_toxicity(docs, none, labels):
    out = toxicity(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)
    assert toxicity(none, labels).count() == 0 and {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_lm_scores(docs, none):
    import public_tokenizers as P

    vocabulary = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    out = lm_scores(docs, vocabulary).collect()
    assert len(out) == len(TEXTS) and all(np.isfinite([r.score, r.base_score]).all() and r.score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 10)} == {1} and lm_scores(none, vocabulary).count() == 0


def test_attention_is_causal_and_its_gradient_right():
    rng = np.random.default_rng(1)
    model = Attention(rng.integers(1, 50, 5000).astype(float))
    for k in ("u1", "u2"):
        model.p[k] += rng.standard_normal(model.p[k].shape).astype(np.float32) * 0.1
    ids = [rng.integers(0, 5000, 50), rng.integers(0, 5000, 7)]
    one = model.log_probabilities(ids)
    other = [ids[0].copy(), ids[1]]
    other[0][30] = (other[0][30] + 1) % 5000
    assert np.allclose(model.log_probabilities(other)[:30], one[:30], atol=1e-5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    win = model.windows(ids)
    grad, _, _ = model.gradient(*win)
    for k in ("q", "v", "o", "x", "r", "u1", "b1"):
        at = (0,) * model.p[k].ndim if k != "r" else (3,)
        ends = []
        for d in (1e-4, -1e-4):
            model.p[k][at] += d
            ends.append(model.log_probabilities(ids).sum())
            model.p[k][at] -= d
        assert abs((ends[0] - ends[1]) / 2e-4 - grad[k][at]) < 2e-2


def test_scoring_from_tables_equals_the_layer():
    rng = np.random.default_rng(2)
    model = Attention(rng.integers(1, 50, 6000).astype(float))
    for k in model.p:
        model.p[k] += rng.standard_normal(model.p[k].shape).astype(np.float32) * 0.1
    ids = [rng.integers(0, 6000, n) for n in (1, 700, 16, 3, 5000, 31)]
    tables = model.tables()
    assert tables["plain"]
    fast, layer = model.log_probabilities(ids, tables), model.log_probabilities(ids, {**tables, "plain": False})
    assert len(fast) == sum(map(len, ids)) and np.allclose(fast, layer, atol=1e-4)
    marked = lambda no: no % 3 == 1
    every, some = model.windows(ids), model.windows(ids, marked)
    assert all((a[marked(np.arange(len(a)))] == b).all() for a, b in zip(every, some))


def test_url_filter(spark):
    captures = spark.createDataFrame([(1, "http://a.b.org/x/y?q", "2024-01-02 00:00:00"), (2, "http://A.b.org:80/x", "2024-01-05 00:00:00"), (3, None, "2024-01-05 00:00:00"), (4, "nonsense", None), (1, "http://a.b.org/x/y?q", "2024-01-02 00:00:00")], "page_id int, url string, fetched_at string")
    captures = captures.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    entries = spark.createDataFrame([("b.org", "block", "2024-01-01 00:00:00"), ("b.org", "none", "2024-01-04 00:00:00"), ("a.b.org/x", "allow", "2024-01-02 00:00:00"), ("a.b.org/x", "block", "2024-01-02 00:00:00"), (None, "block", "2024-01-01 00:00:00")], "pattern string, verdict string, effective_at string")
    entries = entries.withColumn("effective_at", F.col("effective_at").cast("timestamp"))
    got = sorted((r.page_id, r.verdict, r.pattern, r.n_active) for r in url_filter(captures, entries).collect())
    assert got == [(1, "block", "a.b.org/x", 2), (1, "block", "a.b.org/x", 2), (2, "block", "a.b.org/x", 1), (3, "none", None, 0), (4, "none", None, 0)]
    assert url_filter(captures, entries.limit(0)).where("verdict <> 'none'").count() == 0 and url_filter(captures.limit(0), entries).count() == 0


def test_block_similarities_are_exact():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)]
    weights = Weights(np.zeros(0, np.uint64), np.zeros(0), 1.5)

    def shingles(text):
        words = text.split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))

    block = [{"node": bytes([i]), "label": b"", "text": t} for i, t in enumerate(texts)]
    mine, theirs = (Items(part, WordHash(), weights, 5) for part in (block[:20], block[20:]))
    want = [[(shingles(a) & shingles(b)).total() / (shingles(a) | shingles(b)).total() for b in texts[20:]] for a in texts[:20]]
    assert np.allclose(mine.similar(theirs), want)


def test_steps_take_every_block_of_every_text(spark):
    """64 short texts, each with a word of a class of its own: a class moves only if its text was a target."""
    import public_tokenizers as P

    from skydrift.llm.lm_score import PER_CLASS, Subwords, steps

    vocabulary = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    known, words, at = Subwords(*vocabulary), [], []
    for w in (a + b for a in "bcdfghlmnprstw" for b in ("a", "an", "at", "e", "en", "er", "i", "in", "it", "o", "on", "or")):
        ids = known.of([w.encode()])
        if len(ids) == 2 and ids[0] not in at:
            words.append(w), at.append(ids[0])
    words, at = words[:60], at[:60]
    assert len(at) == 60
    counts = np.zeros(known.end + 1)
    rest = np.setdiff1d(np.arange(len(counts) - 1), at)
    for i, x in enumerate(at):  # the first of its class
        counts[x] = 1e6 - i * PER_CLASS
        fill = rest[i * (PER_CLASS - 1) : (i + 1) * (PER_CLASS - 1)]
        counts[fill] = 1e6 - i * PER_CLASS - 1 - np.arange(len(fill))
    start = Attention(counts)
    assert sorted(start.place[at] // PER_CLASS) == list(range(60))
    docs = spark.createDataFrame([(" ".join([w] * 20),) for w in words], "text string").coalesce(1)
    moved = np.abs(steps(docs, start, vocabulary, rate=0.01).p["b2"] - start.p["b2"])[:60].max(1) > 1e-4
    assert moved.all()


def test_cutoffs_reject_at_the_production_parameters(spark):
    """A stratum that certifies alone, and three that only do so together; each has bad documents of two kinds."""
    rng = np.random.default_rng(4)
    word = lambda n=6: "".join(rng.choice(list("abcdefgh"), n))
    def text(kind):
        return " ".join(word(30 if kind == 1 else 6) + ("###" if kind == 0 else "") for _ in range(60))
    rows = [(i, text(i % 20), "en" if i < 1000 else ("fr", "de", None)[i % 3]) for i in range(2000)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 20 > 1)) for i in range(2000)], "doc_id long, quality int")).collect()
    good = [r.kept for r in out if r.doc_id % 20 > 1]
    assert sum(good) >= 0.99 * len(good) and not any(r.kept for r in out if r.doc_id % 20 <= 1)


@pytest.mark.parametrize("parts", [1, 60])
def test_frequent_shingles_are_exact_and_few_are_collected(spark, monkeypatch, parts):
    """A license line in two thirds of the texts, in one partition and in one row each: the same weights as by brute force."""
    from skydrift.llm.near_dedup import frequent_shingles, shingle_sets

    rows = [" ".join(f"w{i}x{j}" for j in range(50)) + (" this line is in most of all texts" if i % 3 else "") for i in range(60)]
    got, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: got.append(collect(self)) or got[-1])
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(parts)
    out = frequent_shingles(docs, 5)
    each = [set(shingle_sets([t.encode().split()], WordHash(), 5)[1].tolist()) for t in rows]
    held = Counter(s for x in each for s in x)
    want = {s: 1 + np.log(60 / n) for s, n in held.items() if 2 * n > 60}
    assert len(want) == 4
    assert dict(zip(out.shingles.tolist(), out.idf)) == pytest.approx(want)
    assert max(map(len, got)) <= 4 * sum(map(len, each)) / 60


def test_shingles_of_most_texts_weigh_less(spark):
    """Two texts that share only what all texts hold are less alike by IDF."""
    common = " ".join(f"c{j}" for j in range(100))
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(4))
    rows = [(i, f"{common} {own(i)}") for i in range(2)]
    out = []
    for weights in (Weights(np.zeros(0, np.uint64), np.zeros(0), 1 + np.log(2.0)), None):
        if weights is None:
            from skydrift.llm.near_dedup import frequent_shingles

            weights = frequent_shingles(spark.createDataFrame(rows, "id long, text string"), 5)
            assert len(weights.shingles) == 96 and np.allclose(weights.idf, 1.0)
        one, two = (Items([{"node": bytes([i]), "label": b"", "text": t}], WordHash(), weights, 5) for i, t in rows)
        out.append(one.similar(two)[0, 0])
    rest = 1 + np.log(2.0)
    assert np.allclose(out, [96 / 104, 96 / (96 + 8 * rest)])


def test_rare_ids_have_weights_of_their_own():
    """Beyond the 4,096 most frequent ids, which id follows depends on the id before it, and probabilities add up to one."""
    from skydrift.llm.lm_score import Adam

    counts = np.concatenate([np.full(5000, 9.0), np.ones(4)])
    model, pairs = Attention(counts), [np.array([5000, 5001] * 20), np.array([5002, 5003] * 20)]
    adam = Adam(model, 0.004)
    for _ in range(700):
        adam.step(*model.windows(pairs))
    log = lambda a, x: model.log_probabilities([np.array([a, a + 1, a, x, 0])])[3]
    assert log(5000, 5001) > log(5000, 5003) + 2 and log(5002, 5003) > log(5002, 5001) + 2
    goal = np.arange(len(counts))
    h = np.repeat(model.context(*model.windows(pairs)[:2])[-1].reshape(-1, 16)[:1], len(goal), 0)
    assert np.exp(model.outputs(h, goal)[0]).sum() == pytest.approx(1, abs=1e-4)


def test_words_are_tokenised_once_for_all_tasks_of_a_worker():
    """A full table of words keeps those that came again; ids stay those of the tokenizer."""
    from skydrift.llm.catalog import tokenizer_file
    from skydrift.llm.packing import WordIds, word_ids

    path = tokenizer_file("word_bpe_49k.json")
    assert word_ids(path) is word_ids(path)
    known, texts = WordIds(path, 60), [" ".join(f"Word{i % 7}, x{i}y. caf\u00e9 <|a|>" for i in range(j, j + 9)) for j in range(0, 90, 9)] + [None, "", "Word1,"]
    want = [np.asarray(known.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [known.encode([t])[0] for t in texts] == want and known.encode(texts) == want
    assert b"Word1," in known and len(known) < 200
    known.learn({b"once"}), known.forget()
    assert b"once" not in known and b"Word1," in known


def test_texts_that_share_a_common_passage_alone_are_no_duplicates(spark):
    """120 different texts, 18 of them with one passage: 0.82 alike by plain counts, less by IDF. Two copies with an edit stay linked."""
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, (f"{passage} " if i < 18 else "") + " ".join(f"w{i}x{j}" for j in range(6 if i < 18 else 80))) for i in range(120)]
    rows += [(200, " ".join(f"w50x{j}" for j in range(78)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.class_id for r in near_duplicates(docs, ceiling=1.0).collect()}
    assert {plain[i] for i in range(18)} == {0} and plain[200] == 50
    out = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert out == {i: i for i, _ in rows} | {200: 50}


@pytest.mark.parametrize("parts", [1, 7])
def test_common_shingles_of_a_sorted_table_are_counted_whole(spark, parts):
    """A line that stands only in the first tenth of a sorted table, so that most chunks do not report it."""
    from skydrift.llm.near_dedup import frequent_shingles, shingle_sets

    rows = [" ".join(f"w{i}x{j}" for j in range(9)) + (" this line is in a few of all texts" if i < 200 else " rare" if i == 1999 else "") for i in range(2000)]
    rows[1500] += " this line is in a few of all texts"
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartitionByRange(parts, "id")
    out = frequent_shingles(docs, 5, 16.0)
    held = Counter(s for t in rows for s in set(shingle_sets([t.encode().split()], WordHash(), 5)[1].tolist()))
    want = {s: 1 + np.log(2000 / n) for s, n in held.items() if n * 16 > 2000}
    assert len(want) == 5 and dict(zip(out.shingles.tolist(), out.idf)) == pytest.approx(want) and out.rest == pytest.approx(1 + np.log(16))


@pytest.mark.parametrize("scale", [0.1, 40.0])
def test_softmax_levels_hold_for_large_weights(scale):
    """Logarithms and gradients in single precision as by a plain softmax in double; exponents of 40 and more overflowed or vanished."""
    rng = np.random.default_rng(5)
    model = Attention(rng.integers(1, 50, 6000).astype(float))
    h, u, b = rng.uniform(-1, 1, (300, 16)).astype(np.float32), (rng.standard_normal((65, 16)) * scale).astype(np.float32), np.zeros(65, np.float32)
    own, grads = rng.integers(0, 65, 300), (np.zeros_like(u), np.zeros_like(b))
    logs, dh = model._level(h, u, b, own, grads)
    z = h.astype(float) @ u.T.astype(float)
    z -= z.max(1, keepdims=True)
    want = z[np.arange(300), own] - np.log(np.exp(z).sum(1))
    d = -np.exp(z) / np.exp(z).sum(1, keepdims=True)
    d[np.arange(300), own] += 1
    assert np.isfinite(logs).all() and np.allclose(logs, want, rtol=1e-4, atol=1e-3)
    assert np.allclose(grads[0], d.T @ h, atol=1e-2) and np.allclose(grads[1], d.sum(0), atol=1e-2) and np.allclose(dh, d @ u, atol=1e-2 * scale + 1e-4)
