"""The class models against a plain reading of their formula, and expressions of two words."""

import random
from collections import defaultdict
from math import exp, log

import numpy as np
import pytest

from skydrift.llm.toxicity import ORDER, STRENGTH, KneserNey, Scorer, count_expressions, expressions, tokens, toxicity

WORDS = ["sun", "sunny", "sunset", "moon", "moony", "tree", "trees", "öl", "a", "and"]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) + (" sunbad moonbad" if i % 3 == 0 and i % 2 else ""), int(i % 3 == 0)) for i in range(60)]
    return list(dict.fromkeys(rows))


def brute(sample):
    """Evidence of any tuple of words, from dictionaries keyed by the expressions themselves."""
    n = defaultdict(lambda: [0, 0])
    for text, toxic in sample:
        words = [w.encode() + b"\x02" for w in text.lower().split()]
        held = {("stem", w[:k]) for w in words for k in range(1, len(w) + 1)}
        held |= {tuple(words[i : i + k]) for k in range(2, ORDER + 1) for i in range(len(words) - k + 1)}
        for x in held:
            n[x][0 if toxic else 1] += 1
    n = {x: c for x, c in n.items() if sum(c) >= 2}
    level = lambda x: 1 if x[0] == "stem" else len(x)
    head = lambda x: ("stem", x[1][:-1]) if x[0] == "stem" else x[:-1]
    below = defaultdict(list)
    for x in n:
        below[level(x), head(x)].append(x)

    def discount(k, c):
        once, twice = (sum(1 for x, v in n.items() if level(x) == k and v[c] == j) for j in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    d = {(k, c): discount(k, c) for k in range(1, ORDER + 1) for c in (0, 1)}

    def step(x, lean):
        k, siblings = level(x), below[level(x), head(x)]
        shared, p = sum(n[x]) / sum(sum(n[y]) for y in siblings), []
        for c in (0, 1):
            whole, kinds = sum(n[y][c] for y in siblings), sum(n[y][c] > 0 for y in siblings)
            p.append((max(n[x][c] - d[k, c], 0) + (d[k, c] * kinds + STRENGTH) * shared * exp((1 - 2 * c) * lean / 2)) / (whole + STRENGTH))
        return log(p[0] / p[1])

    def evidence(words):
        words = tuple(w if w.endswith(b"\x02") else w + b"\x02" for w in words)
        if len(words) == 1:
            starts = [("stem", words[0][:k]) for k in range(1, len(words[0]) + 1)]
            return sum(step(x, 0.0) for x in starts if x in n)
        if words not in n:
            return evidence(words[1:])
        lower = words[1:]
        return step(words, evidence(lower) if len(lower) == 1 or lower in n else 0.0)

    return evidence


def fitted(spark, sample):
    return KneserNey(count_expressions(spark.createDataFrame(sample, "text string, toxic int").repartition(4)).toArrow())


def test_evidence_follows_the_formula(spark, sample):
    model, wanted = fitted(spark, sample), brute(sample)
    for text, _ in [*sample, ("sunburn unknown moonlight sun", 0), ("x", 0), ("sunbad moonbad tree", 0)]:
        words = tokens(text)
        single, keys = model.evidence(words)
        assert np.allclose(single, [wanted((w,)) for w in words])
        assert np.allclose(model.in_sequence(keys, single), [wanted(tuple(words[max(0, i - ORDER + 1) : i + 1])) for i in range(len(words))])
    assert model.evidence([b"sunbad"])[0][0] > 1 > abs(model.evidence([b"unknown"])[0][0])


def test_expressions_of_a_text():
    rows = expressions(tokens("Ab, ab c"))
    assert sorted(rows[0].tolist()) == [-3, -2, -2, -1, -1, 2, 2, 3]  # a, ab, ab-end, c, c-end; two pairs, one triple
    assert len(set(rows[1].tolist())) == 8


def test_measures_do_not_depend_on_groups(spark, sample):
    model = fitted(spark, sample)
    texts = [None, "", *[t for t, _ in sample], " ".join(t for t, _ in sample) * 700, "y" * 300_000]
    together = Scorer(model).measures(texts)
    alone = np.concatenate([Scorer(model, limit=0).measures([t]) for t in texts])
    assert np.allclose(together, alone) and (together[:2] == 0).all() and together[-2, 0] > 100_000


def test_words_and_pairs_of_words_are_found_on_held_out_documents(spark):
    """Toxic are forms of one stem, and a pair of words that are harmless apart."""
    rng = random.Random(11)
    plain = ["".join(rng.choices("abdeimnorst", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1_500):
        words = rng.choices(plain, k=60)
        toxic = i % 5 == 0
        if i % 2:
            words[10:10] = ["green"]
            words[40:40] = ["goblin"]
        if toxic and i % 2:
            for at in (5, 25, 45):
                words[at:at] = ["green", "goblin"]
        elif toxic:
            for at in (5, 25, 45):
                words[at:at] = ["vuxk" + rng.choice(["ing", "ed", "er", "est", "o", "ly", "ness", "y"])]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    for odd in (0, 1):
        part = [r for r in out if r.doc_id % 2 == odd]
        found = [r.predicted for r in part if r.doc_id % 5 == 0]
        assert sum(found) >= 0.9 * len(found), (odd, sum(found), len(found))
        assert sum(r.predicted for r in part if r.doc_id % 5) <= 0.02 * len(part)
