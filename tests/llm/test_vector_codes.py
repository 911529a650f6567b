"""Vector codes against plain assignment and means."""
import hashlib
import random

import numpy as np
import pytest

from marketframe.llm import vector_codes
from marketframe.llm.vector_codes import compress, digest, distinct_parts, nearest_entries


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    n = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * n:(p + 1) * n] for _, v, _ in first] for p in range(parts)]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(assign(v[p * n:(p + 1) * n], books[p])[1], []).append(v[p * n:(p + 1) * n])
            for k, group in held.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    out = []
    for i, v, label in kept:
        found = [assign(v[p * n:(p + 1) * n], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return [(i, c, e, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in out]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows],
                                 "vec_id long, embedding array<float>, label int, row string, whole int")


def check(spark, rows):
    got = digest(*compress(table(spark, rows).repartition(3))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    return got


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, .2) for _ in range(32)], rng.choice([0, 1, 2, None])) for i in range(200)]
    hot = [.25] * 16 + [-.5] * 16
    rows += [(1000 + i, hot, 4) for i in range(150)] + [(3, rows[3][1], 1), (3, rows[9][1], None)]
    rows += [(900, None, 1), (901, [float("nan")] + [0.] * 31, 1), (902, [None] * 32, 2), (903, [float("inf")] * 32, 2),
             (None, [.1] * 32, 3), (904, [-.1] * 20, None), (905, [], 3)]
    assert len(check(spark, rows)) == 200 + 150 + 2 + 3


def test_ties_take_the_lower_index_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 3)] * 16, 0) for i in range(70)]
    got = check(spark, rows)
    assert {r.code for r in got} == {"00" * 16, "01" * 16, "02" * 16} and {r.error for r in got} == {0}


def test_few_and_no_vectors(spark):
    check(spark, [(4, [1., -2.] * 8, 1), (2, [.5] * 16, 1)])
    check(spark, [(1, [1.0] * 7, 1), (2, [2.0] * 7, 2), (3, [3.0] * 7, 2)])
    assert digest(*compress(table(spark, []))).collect() == []
    assert digest(*compress(table(spark, [(1, None, 0)]))).collect() == []


def test_trie_shares_nothing_wrongly(monkeypatch):
    rng = np.random.default_rng(4)
    for leaves in (1, 5, 8192):
        monkeypatch.setattr(vector_codes, "LEAVES", leaves)
        parts, book = rng.integers(-3, 4, (400, 4)), rng.integers(-3, 4, (9, 4))
        distinct, count, leaf = distinct_parts(parts)
        assert count.sum() == 400 and (distinct[leaf] == parts).all()
        code, least = nearest_entries(distinct, book)
        away = ((distinct[:, None] - book) ** 2).sum(axis=2)
        assert (code == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()


def test_two_digits_are_enough(spark):
    with pytest.raises(ValueError):
        compress(table(spark, []), entries=257)
