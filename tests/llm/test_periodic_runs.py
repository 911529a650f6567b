"""Periodic runs against plain comparison of all periods."""
import hashlib
import random
import zlib

import numpy as np

from marketframe.llm import periodic_runs
from marketframe.llm.periodic_runs import digest, find_runs, repeated_tail, runs_of


def brute(words):
    """Runs by definition: (start, length, period)."""
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def line(doc_id, text):
    """The row of the query, worked out one word at a time."""
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 3
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def made(rng, n):
    words, k = [], rng.choice([1, 2, 3, 6])
    while len(words) < n:
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 8))[:rng.randint(1, 60)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        texts = [made(rng, rng.randint(0, 150)) for _ in range(rng.randint(1, 5))]
        texts.append(texts[0])
        ids = {w: k for k, w in enumerate({w for t in texts for w in t})}
        if sum(map(len, texts)) <= len(ids):
            continue
        got = runs_of([np.array([ids[w] for w in t], np.int64) for t in texts])
        assert [[(a, b - a, q) for a, b, q in g] for g in got] == [brute(t) for t in texts]


def test_small_passes_and_few_rounds_change_nothing(monkeypatch):
    rng = random.Random(9)
    texts = [np.array(made(rng, 200), np.int64) for _ in range(20)]
    want = runs_of(texts)
    monkeypatch.setattr(periodic_runs, "TESTS", 7)
    assert runs_of(texts) == want
    monkeypatch.setattr(periodic_runs, "ROUNDS", 1)
    assert runs_of(texts) == want


def test_colliding_hashes_do_not_change_the_result(monkeypatch):
    rng = random.Random(10)
    texts = [np.array(made(rng, 120), np.int64) for _ in range(10)]
    want = runs_of(texts)
    # hashes of a few bits only: long extensions are wrong and get compared
    plain = periodic_runs.mix
    monkeypatch.setattr(periodic_runs, "mix", lambda x: plain(x) & np.uint64(1))
    assert runs_of(texts) == want


def test_rows_equal_brute_force(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{w}" for w in made(rng, rng.randint(0, 120)))) for i in range(80)]
    rows += [(5, rows[5][1]), (5, "other words"), (None, "a " * 12), (7, None), (8, ""), (9, " \t\n "),
             (10, "a b a b   x\x0by\x0cz"), (11, "ä ö " * 9)]
    got = digest(find_runs(docs_of(rows), order=repeated_tail)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(line(*r)) for r in rows)
    assert any(r[1] for r in got)


def test_long_texts(docs_of):
    one = "la " * 300_000
    mixed = " ".join(f"u{i}" for i in range(50_000)) + " " + " ".join(f"v{i}" for i in range(5000)) * 1
    cycle = " ".join(["x " + " ".join(f"c{i}" for i in range(999))] * 40)
    got = {r.doc_id: r for r in find_runs(docs_of([(1, one), (2, mixed), (3, cycle)])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "la"
    assert got[2].runs == [] and got[2].collapsed == mixed
    assert [tuple(r) for r in got[3].runs] == [(0, 40_000, 1000)] and len(got[3].collapsed.split()) == 1000


def test_empty_table(docs_of):
    assert digest(find_runs(docs_of([]))).collect() == []
