import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from marketframe.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_once_in_gapless_sequences(docs_of, prose):
    pairs = [(k, prose(3 + 37 * k % 700, k)) for k in range(80)] + [(90, ""), (91, None), (92, prose(20000, 1)), (5, "again")]
    pairs += [(100 + k, "same length text") for k in range(50)]
    rows = P.pack(docs_of(pairs), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for doc, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_text[doc, len(ids)], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in own]).tolist() == ids
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    used = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.03 * used / P.CAPACITY + 2


def test_empty_table(docs_of):
    assert P.pack(docs_of([]), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_program_meets_its_bound(seed):
    demand = np.random.default_rng(seed).integers(0, 40, 64)
    patterns, uses = P.solve(demand, 64)
    assert ((patterns * np.arange(1, 65)).sum(axis=1) <= 64).all()
    assert np.allclose(patterns.T @ uses, demand, atol=1e-6)
    least = (demand * np.arange(1, 65)).sum() / 64
    assert least - 1e-6 <= uses.sum() <= 1.06 * max(least, demand[32:].sum())
    runs = P.plan(demand, 64)
    assert np.bincount([r[0] for r in runs], [r[2] - r[1] for r in runs], 65)[1:].tolist() == demand.tolist()
