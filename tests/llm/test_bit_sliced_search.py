"""Bit-sliced search against scoring every row."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import bit_sliced_search
from marketframe.llm.bit_sliced_search import Block, nearest


def brute(rows, k=5):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), c is None, c or 0)
                            for b, (c, w) in enumerate(kept) if b != a)
            out += [(q, r + 1, None if null else c, -s) for r, (s, null, c) in enumerate(scored[:k])]
    return out


def check(spark, rows, tables=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, number string, lane int")
    got = nearest(df.repartition(tables), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    return got


@pytest.mark.parametrize("block,group", [(16384, 2048), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(bit_sliced_search, "BLOCK", block)
    monkeypatch.setattr(bit_sliced_search, "GROUP", group)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, .3) for _ in range(24)]) for i in range(300)]
    hot = [.3, -.3] * 12
    # ties by the dozen, repeated ids, rows that take no part, short vectors
    rows += [(1000 + i, hot) for i in range(200)] + [(50, rows[50][1]), (50, rows[7][1]), (100, rows[50][1])]
    rows += [(2000, None), (2050, [None] * 24), (2100, [float("nan")] * 24), (2150, [float("-inf")] * 24),
             (None, hot), (None, rows[0][1]), (2200, [.9] * 10), (2250, [])]
    got = check(spark, rows)
    assert len({r.query_id for r in got}) == 6 + 4 + 2


def test_small_and_empty_tables(spark):
    assert check(spark, [(50, [1., 2.])]) == []
    assert len(check(spark, [(50, [1., 2.]), (1, [0., 0.]), (100, [-1., 1.])])) == 4
    assert check(spark, []) == [] and check(spark, [(50, None)]) == [] and check(spark, [(7, [1.])]) == []


def test_blocks_are_exact_at_any_size_of_number():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, dim, size = int(rng.integers(1, 200)), int(rng.integers(1, 20)), int(10 ** rng.integers(0, 8))
        values = rng.integers(-size, size + 1, (n, dim))
        values[rng.integers(0, n, n // 3)] = values[0]
        query, own, k = values[rng.integers(0, n)], int(rng.integers(-1, n)), int(rng.integers(1, 8))
        rows, score = Block(values).best(query, k, own)
        exact = values @ query
        others = [i for i in range(n) if i != own]
        least = sorted(exact[others])[-k] if len(others) > k else -np.inf
        assert rows.tolist() == [i for i in others if exact[i] >= least] and (score == exact[rows]).all()
