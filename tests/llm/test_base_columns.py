"""Columns that the contract fixes, recomputed in plain Python over whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from skydrift.llm import catalog
from skydrift.llm.lm_score import PART, add_parts
from skydrift.llm.pii import base_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), name) for k, (name, pattern, good) in enumerate(kinds) for m in re.finditer(pattern, text) if good(m[0]))


def test_pii_base_columns(spark, sf):
    rows = {r.doc_id: r for r in catalog.QUERIES["op9_pii"](spark, sf).collect()}
    docs = catalog.table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, r = plain_spans(d.text or ""), rows[d.doc_id]
        listed = [f"{name}:{s}:{e}" for s, _, e, name in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _, _ in spans) for j in range(4)]
        assert set(listed) <= set(filter(None, r.spans.split(",")))


def test_pii_patterns_on_random_strings():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("0123456789.+-@ aZ_%()1155ñ\n", k=rng.randint(0, 50)))
        assert base_spans(text) == [(s, k, e) for s, k, e, _ in plain_spans(text)]


def test_lm_base_columns(spark, sf):
    rows = {r.doc_id: r for r in catalog.QUERIES["op7_lm_score"](spark, sf).collect()}
    docs = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), None] for r in catalog.table(spark, sf, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(t for i, tokens in docs.items() if not held[i] for t in tokens)
    n, v = sum(c.values()), len(c)
    assert rows.keys() == docs.keys()
    for i, tokens in docs.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-9)


def test_weights_add_up_in_parts_whatever_the_batches():
    rng = np.random.default_rng(2)
    vectors, tokens = rng.standard_normal((7, 3 * PART + 11)), rng.integers(1, 100, 7)
    rows = [(no, (v * n)[no * PART : (no + 1) * PART].tobytes(), int(n)) for v, n in zip(vectors, tokens) for no in range(4)]
    random.Random(4).shuffle(rows)
    for size in (1, 5, 28):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + size]), (pa.int32(), pa.binary(), pa.int64()))], ["no", "weights", "n"]) for lo in range(0, len(rows), size)]
        (out,) = add_parts(iter(batches))
        got = dict(zip(out.column("no").to_pylist(), out.column("weights").to_pylist()))
        assert np.allclose(np.concatenate([np.frombuffer(got[k]) for k in range(4)]), tokens @ vectors)
        assert set(out.column("n").to_pylist()) == {int(tokens.sum())}
