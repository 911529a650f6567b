import pytest

from marketframe.llm import decontaminate as D


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        have = grams(text)
        for i, item in items:
            if item is None or not grams(item):
                continue
            question = item.strip("\n").rpartition("\n")[0] or item
            q = grams(question)
            if len(grams(item) & have) >= 0.5 * len(grams(item)) or (q and len(q & have) >= 0.9 * len(q)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [10 ** 6, 200])
def test_equals_brute_force(spark, docs_of, prose, shard):
    items = [(k, prose(25 + k, 40 + k) + ("\n" + prose(8, 90 + k) if k % 2 else "")) for k in range(30)]
    items += [(100, "too short"), (101, None), (102, ""), (5, items[5][1]), (103, prose(300, 8))]
    leaks = []
    for k in range(30):
        text = items[k][1]
        w = text.split(" ")
        leaks += [(10 * k, prose(200, 300 + k) + " " + text + " " + prose(50, k)), (10 * k + 1, text.upper()),
                  (10 * k + 2, prose(90, 400 + k) + " " + " ".join(w[:6]) + " " + prose(90, k)),
                  (10 * k + 3, prose(60, 600 + k) + " " + " ".join(w[:len(w) * 2 // 3 + 5]) + " " + prose(60, k)),
                  (10 * k + 4, prose(150, 800 + k))]
    leaks += [(9001, ""), (9002, None), (9003, prose(20000, 3) + " " + items[3][1]), (7, leaks[0][1]), (9004, items[34][1])]
    found = D.contaminated(docs_of(leaks), spark.createDataFrame(items, "item_id long, text string"), shard_postings=shard)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute(leaks, items)


@pytest.mark.parametrize("shard", [10 ** 6, 300])
def test_long_items_and_far_parts(spark, docs_of, prose, shard):
    """Items longer than a passage, questions with long answers, parts far apart."""
    items = [(1, prose(400, 11)), (2, prose(2000, 12)), (3, prose(30, 13) + "\n" + prose(300, 14)),
             (4, prose(70, 15) + "\n" + prose(2000, 16)), (5, prose(60, 17)), (6, prose(300, 18)),
             (7, "ab cd ef\ngh ij"), (8, prose(40, 19)), (8, prose(40, 20))]
    word = {k: t.split() for k, (_, t) in enumerate(items)}
    leaks = []
    for k, (i, text) in enumerate(items):
        n, w = len(word[k]), word[k]
        far = "".join(f" {prose(190, 5000 + j)} " + " ".join(w[j:j + 12]) for j in range(0, n, 24))
        leaks += [(10 * k, prose(37, 70 + k) + " " + text + " " + prose(90, k)),
                  (10 * k + 1, prose(33, 80 + k) + " " + " ".join(w[:n // 2 + 4])),
                  (10 * k + 2, " ".join(w[n // 2 - 4:]) + " " + prose(50, 90 + k)),
                  (10 * k + 3, prose(45, 60 + k) + " " + text.split("\n")[0] + " " + prose(200, 50 + k)),
                  (10 * k + 4, " ".join(w[:n // 3])), (10 * k + 5, far),
                  (10 * k + 6, "".join(f" {prose(190, 6000 + j)} " + " ".join(w[j:j + 16]) for j in range(0, n, 16)))]
    found = D.contaminated(docs_of(leaks), spark.createDataFrame(items, "item_id long, text string"), shard_postings=shard)
    got = found.collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(leaks, items)
    assert {(0, 1), (11, 2), (23, 3), (33, 4), (46, 5), (70, 8), (80, 8)} <= {(r["doc_id"], r["item_id"]) for r in got}
    assert all(r["score"] > 0 for r in got)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs_of([(1, "a b c d e f")]), none).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(docs_of([]), items).count() == 0


def test_pairs_come_from_the_index(spark, docs_of, prose):
    """Nothing is reported that BM25 did not retrieve."""
    items = [(k, prose(80, 40 + k)) for k in range(20)]
    docs = docs_of([(k, prose(100, 300 + k) + " " + items[k][1]) for k in range(20)])
    table = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(docs, table).count() == 20
    assert D.contaminated(docs, table, threshold=99.0).count() == 0


def test_blocks_are_skipped_without_loss(prose):
    """Scores of all pieces at or above a threshold equal plain sums, in lots of any size."""
    import numpy as np
    shared = prose(20, 1)
    items = {k: (k, " ".join([prose(20, 50 + k), shared, prose(30, 90 + k % 5)])) for k in range(70)}
    rows = []
    for k, (_, text) in items.items():
        for n, grams in enumerate(D._pieces(text)):
            terms, tf = np.unique(grams.view(np.int64), return_counts=True)
            rows += [dict(entry=k, piece=n, term=t, tf=c, length=len(grams)) for t, c in zip(terms.tolist(), tf.tolist())]
    df = {}
    for r in rows:
        df[r["term"]] = df.get(r["term"], 0) + 1
    shard = D.Shard.build([r | {"df": df[r["term"]]} for r in rows], items, 140, 33.0)
    term = np.concatenate([np.unique(np.searchsorted(shard.terms, D._grams(D._hashes(t)).view(np.int64)))
                           for _, t in list(items.values())[:12]])
    n = [len(np.unique(D._grams(D._hashes(t)))) for _, t in list(items.values())[:12]]
    passage = np.repeat(np.arange(12), n)
    start = np.searchsorted(np.concatenate([shard.block_at]), np.arange(shard.block_at[-1]), "right") - 1
    of = np.repeat(start, np.diff(shard.at))        # the term of every posting
    for threshold in (0.01, 0.3, 0.9):
        want = {}
        for p, t in zip(passage.tolist(), term.tolist()):
            for j in np.flatnonzero(of == t).tolist():
                key = p, int(shard.piece[j])
                want[key] = want.get(key, 0.0) + float(shard.impact[j])
        want = sorted((p, int(shard.item_of[k]), round(s, 9)) for (p, k), s in want.items() if s >= threshold)
        old = D.LOT
        try:
            for D.LOT in (1, 300, 1 << 20):
                got = sorted((p, i, round(s, 9)) for p, i, s in shard.retrieve(passage, term, threshold))
                assert got == want
        finally:
            D.LOT = old
