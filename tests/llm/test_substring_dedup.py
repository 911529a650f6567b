import contextlib
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketframe.llm import substring_dedup as S


def brute(pairs):
    raws = [(i, (t or "").encode()) for i, t in pairs]
    count = Counter(r[j:j + 200] for _, r in raws for j in range(len(r) - 199))
    out = []
    for i, r in raws:
        covered = np.zeros(len(r), bool)
        for j in range(len(r) - 199):
            if count[r[j:j + 200]] > 1:
                covered[j:j + 200] = True
        edge = np.diff(np.concatenate(([0], covered.astype(int))))
        kept = np.frombuffer(r, np.uint8)[~covered].tobytes()
        out.append((i, len(r), int(covered.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(prose):
    passage, base = prose(70, 1), prose(300, 2)
    words = base.split(" ")
    pairs = [(k, prose(40, 10 + k) + " " + passage + " é " + prose(30, 50 + k)) for k in range(12)]
    pairs += [(100 + k, " ".join(words[:50 + 9 * k] + ["edit"] + words[51 + 9 * k:])) for k in range(8)]
    pairs += [(200, base), (201, base), (202, base[:150]), (203, base[:150]), (204, passage + " mid " + passage)]
    pairs += [(205, "ab" * 300), (206, "z" * 500), (207, ""), (208, None), (209, passage[:199]), (210, passage[:200]),
              (None, "null id " + passage), (207, "same id " + passage), (211, "\x00" * 250 + "tail")]
    pairs += [(300 + k, prose(90, 400 + k)) for k in range(10)] + [(400, prose(4000, 5))]
    return pairs


@pytest.mark.parametrize("group, block", [(2000, 1 << 18), (2000, 500), (1, 1 << 18)])
def test_equals_brute_force(docs_of, prose, monkeypatch, group, block):
    """Sorted in large and small blocks, and counted over the cluster."""
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    pairs = corpus(prose)
    rows = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["runs"]), len(r["runs"]), r["kept_sha256"])
            for r in S.remove_repeats(docs_of(pairs)).collect()]
    assert sorted(rows, key=str) == brute(pairs)


@pytest.mark.parametrize("ids", [(5, 5, 5, 5), (None, None, None, None), (5, None, 5, None)])
def test_repeated_and_null_ids(docs_of, prose, ids):
    passage = prose(75, 1)
    pairs = [(i, prose(15, 20 + k) + " " + passage + " " + prose(11 + k, 40 + k)) for k, i in enumerate(ids)]
    pairs += [(ids[0], pairs[0][1][:150]), (ids[1], prose(60, 7)), (ids[1], prose(60, 7)), (ids[2], None), (9, prose(60, 8))]
    rows = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["runs"]), len(r["runs"]), r["kept_sha256"])
            for r in S.remove_repeats(docs_of(pairs)).collect()]
    assert sorted(rows, key=str) == brute(pairs)


def test_contexts_move_once(spark, docs_of, prose, monkeypatch):
    """Of all tables that are written, one shuffle holds contexts."""
    moved, write = [], S.materialise

    def watched(df):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
        inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan.getvalue())
        moved.extend(x for x in inputs if "context#" in x)
        return write(df)
    monkeypatch.setattr(S, "materialise", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        S.remove_repeats(docs_of(corpus(prose)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(moved) == 1


def test_shuffle_files_go_with_their_query(spark, docs_of, prose, monkeypatch):
    """Each table is written with Spark's clean-up of shuffle files on; the session's own setting comes back."""
    key, write, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", S.materialise, []
    before = spark.conf.get(key)
    monkeypatch.setattr(S, "materialise", lambda df: (seen.append(spark.conf.get(key)), write(df))[1])
    S.remove_repeats(docs_of(corpus(prose)))
    assert seen and set(seen) == {"true"} and spark.conf.get(key) == before


def test_sort_groups_counts_contexts(prose):
    """Rows of equal contexts, in several batches, one with bytes; a row for
    several places; a single context; two that share a part."""
    a, b, c, f = (prose(60, k).encode()[:300] for k in (1, 2, 3, 4))
    d, e = a[:220] + b[:80], a[:220] + c[:80]
    rows = [(1, b"a", 1, 1, 0, 0, 300, None), (1, b"a", 1, 2, 0, 5, 300, a), (1, b"b", 1, 3, 0, 0, 300, b),
            (2, b"a", 3, 4, 0, 7, 300, c), (2, b"b", 1, 5, 0, 0, 300, f), (3, b"a", 1, 6, 0, 0, 300, c),
            (4, b"d", 1, 7, 0, 10, 300, d), (4, b"e", 1, 8, 0, 20, 300, e)]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names=list("adntuslc"))
               for part in (rows[:1], rows[1:5], rows[5:7], rows[7:])]
    out = sorted(x for o in S._sort_groups(batches) for x in zip(*(c.to_pylist() for c in o.columns)))
    assert out == [(1, 0, 0, 300), (2, 0, 5, 305), (4, 0, 7, 307), (7, 0, 10, 230), (8, 0, 20, 240)]


def test_empty_table(docs_of):
    assert S.remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_two_stage_order(seed):
    text = np.random.default_rng(seed).integers(0, 4, 2500).astype(np.uint8)
    text[300:900] = text[1500:2100]
    text[-1] = 0
    raw, order = text.tobytes(), S.two_stage_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    keys = [raw[i:i + 200].split(b"\0")[0] for i in order]
    assert keys == sorted(keys)
    wanted = np.zeros(len(text), bool)
    wanted[200:700] = wanted[1400:1950] = True
    some = S.two_stage_order(text, wanted)
    assert [i for i in some.tolist() if wanted[i]] == [i for i in order.tolist() if wanted[i]] or \
        [raw[i:i + 200].split(b"\0")[0] for i in some if wanted[i]] == [k for i, k in zip(order, keys) if wanted[i]]
