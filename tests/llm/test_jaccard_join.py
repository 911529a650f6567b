import random
import re

import pytest
from pyspark.sql import functions as F

from marketframe.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(pairs):
    """Rows (id, set size, component); rows of one id are one document."""
    rows = [(i, shingles(t)) for i, t in pairs]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(rows):
        for j, b in rows[k + 1:]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in rows)


def near(text, r, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


def corpus(prose, groups=6, copies=40):
    r, pairs = random.Random(3), []
    passage = prose(60, 999)
    for g in range(groups):  # chains around the threshold
        text = prose(r.choice([30, 80, 200]), g)
        for _ in range(12):
            pairs.append(text)
            text = near(text, r, r.choice([0, 1, 2, 4]))
    base = prose(150, 50)
    pairs += [near(base, r, e % 7) for e in range(copies)]
    pairs += [prose(40, 100 + k) + " " + passage + " " + prose(40, 200 + k) for k in range(30)]
    pairs += [prose(100, 300 + k) for k in range(30)]
    pairs += ["", None, "  \n\t", "one two", "One\nTWO", "one two three", "a b c d e", prose(20000, 77)]
    pairs.append(near(pairs[-1], r, 40))
    r.shuffle(pairs)
    return [(7 + 3 * k, t) for k, t in enumerate(pairs)]


@pytest.mark.parametrize("cell, split, groups, copies", [(8 << 20, 2000, 6, 40), (20_000, 5, 6, 40), (1, 50, 2, 12)])
def test_equals_brute_force(docs_of, prose, monkeypatch, cell, split, groups, copies):
    """Also with cells that are split around pivots and finished in blocks."""
    monkeypatch.setattr(J, "CELL_BYTES", cell)
    monkeypatch.setattr(J, "REGION_SPLIT", split)
    pairs = corpus(prose, groups, copies)
    got = sorted(tuple(r) for r in J.jaccard_components(docs_of(pairs)).collect())
    assert got == brute(pairs)


def test_repeated_ids_with_different_texts(docs_of, prose):
    a, b, c = (prose(90, k) for k in (1, 2, 3))
    r = random.Random(1)
    pairs = [(2, a), (5, a), (5, b), (9, b), (11, c), (2, near(c, r, 1)), (20, prose(40, 4)), (20, prose(40, 5)), (21, None),
             (21, near(a, r, 1)), (30, ""), (30, prose(30, 6))]
    got = sorted(tuple(x) for x in J.jaccard_components(docs_of(pairs)).collect())
    assert got == brute(pairs)
    assert {x[2] for x in got if x[0] in (2, 5, 9, 11, 21)} == {2}


def test_homes_and_copies_hold_every_link(spark, prose, monkeypatch):
    """Cells around pivots of texts on a line of edits, none of them alike by
    a first pivot: the home cell of either text of a link holds both."""
    monkeypatch.setattr(J, "CELL_BYTES", 3000)
    r, text, rows = random.Random(2), prose(60, 1), []
    for k in range(80):
        sets = J.shingle_sets([text.encode()], 5)[0]
        rows.append((k, [int(x) for x in sets.view("int64")], len(sets)))
        text = near(text, r, 2)
    df = spark.createDataFrame(rows, "doc long, shingles array<long>, n long")
    links = J._cell_links(df.select(F.lit(1).cast("long").alias("cell"), "doc", "n"), df.select("doc", "shingles")).collect()
    held = {i: set(s) for i, s, _ in rows}
    want = {(a, b) for a in held for b in held if a < b
            and 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])}
    assert {(min(a, b), max(a, b)) for a, b in links} <= want

    def groups(edges):
        up = dict(zip(held, held))
        for _ in held:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up
    assert groups(links) == groups(want)


def test_empty_table_and_repeated_rows(docs_of):
    assert J.jaccard_components(docs_of([])).count() == 0
    rows = J.jaccard_components(docs_of([(4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (None, "x y")]))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(4, 2, 2), (4, 2, 2), (2, 2, 2), (None, 1, None)], key=str)
