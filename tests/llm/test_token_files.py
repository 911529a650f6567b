import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketframe.llm import token_files as T
from marketframe.llm import tokens
from marketframe.llm.tokens import CachedTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 2000), st.integers(0, 10 ** 6))
def test_segment_round_trip(n, symbols, seed):
    ids = np.random.default_rng(seed).integers(0, symbols, n).astype(np.uint32)
    s = T.Segment(T.encode_segment([(3, n)], ids))
    assert (s.ids() == ids).all() and s.doc_ids.tolist() == [3]


def test_blocks_and_checkpoints_decode_alone():
    ids = (np.random.default_rng(1).zipf(1.3, 150_001) % 49_000).astype(np.uint32)
    s = T.Segment(T.encode_segment([(1, len(ids))], ids))
    at = 0
    for b in range(len(s.entries)):
        block, tail = s.block(b), s.block(b, from_checkpoint=True)
        assert (block == ids[at:at + len(block)]).all() and (block[-len(tail):] == tail).all()
        at += len(block)
    assert at == len(ids)


def test_damage_is_noticed():
    data = bytearray(T.encode_segment([(1, 5000)], np.arange(5000, dtype=np.uint32) % 700))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        T.Segment(bytes(data)).ids()


def test_files_hold_all_texts_in_order(docs_of, prose, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 5000)
    pairs = [(97 * k % 101, prose(1 + 7 * k, k)) for k in range(60)]
    pairs += [(500, ""), (501, None), (502, prose(20000, 4)), (-5, "negative id"), (503, "tie"), (503, "tie")]
    rows = T.round_trip(docs_of(pairs), PATH).collect()
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(pairs, key=lambda p: (p[0], p[1] is not None, p[1] or "")):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [T.END_ID], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in rows)
    assert got == sorted(want)


def test_empty_table(docs_of):
    assert T.round_trip(docs_of([]), PATH).count() == 0


PARTS = ["a", "b", " ", "\n", "\t", "  ", "'s", "'S", "1", "é", "!", "\r", "\xa0", "\u0301", "\x1c", "\x85", "Zz", "日本", "ς", "ªº",
         "²", "\u2028", "<|endoftext|>", "</w>", "😀", "\u200d", "it've", "ǅ", "ٱ", "\x00", " ,", "_", "word", "ΑΒ"]


def _fuzz(seed, n=3000):
    r = np.random.default_rng(seed)
    for _ in range(n):
        yield "".join(PARTS[k] for k in r.integers(0, len(PARTS), r.integers(0, 14)))
    for _ in range(n):
        codes = r.choice([r.integers(32, 127), r.integers(0, 0x800), r.integers(0x2000, 0x3100), r.integers(0x10000, 0x1F700)],
                         r.integers(1, 8))
        yield "".join(map(chr, (int(c) for c in codes)))


def test_cached_ids_equal_the_tokenizer():
    cached = CachedTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*_fuzz(2), None, "word " * 3000]
    for _ in range(2):  # new, then looked up
        for text, ids in zip(texts, cached.encode_batch(texts)):
            own = cached.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == own, repr(text)


def test_byte_level_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "COMPARED", 0)
    fast = tokens.ByteLevelTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*_fuzz(3), None, "word " * 3000]:
        own = fast.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert fast.encode(text).tolist() == own, repr(text)


def test_another_vocabulary_is_noticed():
    fast = tokens.ByteLevelTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    fast.fast = type("Other", (), {"encode_to_numpy": lambda self, text, **_: np.zeros(1, np.uint32)})()
    for text in ("some words", "more words"):
        assert fast.encode(text).tolist() == fast.tokenizer.encode(text, add_special_tokens=False).ids
    assert fast.fast is None


def test_marks_behind_words_are_told_apart():
    """Words with marks share the ids of the words; few texts go to the tokenizer."""
    class Counted:
        def __init__(self, tokenizer):
            self.inner, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **kw):
            self.texts += len(texts)
            return self.inner.encode_batch_fast(texts, **kw)

        def encode(self, text, **kw):
            self.texts += 1
            return self.inner.encode(text, **kw)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeñéÉß", k=rng.randint(1, 9))) for _ in range(400)]
    odd = ["İ.", "σΣ,", "é.", "a.́", "don't.", "x9.", "9,", "ﬁ!!", "a²", "'s", "a's", "a'", "...", "a" + "." * 40,
           "Ⅷ.", "a_b", "(a)", "<|a|>", "a̸>"]
    pieces = [w + mark for w in words for mark in ("", ".", ",", "!!", ",###")] + odd
    cached = CachedTokenizer(PATH)
    plain, cached.tokenizer = cached.tokenizer, Counted(cached.tokenizer)
    got = cached.encode_many([" ".join(pieces), *odd])
    want = plain.encode_batch([" ".join(pieces), *odd], add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert cached.tokenizer.texts < 150


def test_tables_of_ids_equal_sorting(monkeypatch):
    ids = np.random.default_rng(5).integers(0, 3000, 70_000).astype(np.uint32) ** 2 // 7
    one = T.encode_segment([(1, len(ids))], ids)
    monkeypatch.setattr(T, "_TABLE_IDS", 0)
    assert T.encode_segment([(1, len(ids))], ids) == one
    assert np.array_equal(T.Segment(one).ids(), ids)


def test_plain_pieces_are_looked_up_without_capitals_and_accents():
    """Capitals, composed accents and inner marks: the whole tokenizer sees none of these texts."""
    cached = CachedTokenizer(PATH)
    plain, cached.tokenizer = cached.tokenizer, None
    pieces = [a + chr(c) + b for c in range(33, 0x300) if chr(c) not in "\x7fİ\xadȺȾ" and not 0x7F < c < 0xA1
              for a, b in (("", ""), ("a", "b"), ("'S", ".."), ("x,", "9"))]
    texts = [" ".join(pieces), "The the THE The. the,", "Cafe\u0301 caf\xe9 CAFÉ, it've IT'VE a.b@c-d"]

    class Left:  # has no piece to do
        def encode_batch_fast(self, texts, **kw):
            assert not texts
            return []
    cached.tokenizer = Left()
    got = cached.encode_many(texts)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"the", "caf\xe9"} <= cached.young.keys() and not {"The", "cafe\u0301", "the."} & cached.young.keys()


def test_accents_that_compose_with_small_letters_only():
    cached = CachedTokenizer(PATH)
    texts = ["Ⱥ. 'SȺ.. x,Ⱥ9 Ⱦ,", "J̌ H̱. T̈x", "İ. İx", "क़. क़,", "É Ώ A", "À. ; ̈́", "", None]
    for _ in range(2):
        got = cached.encode_many(texts)
        assert [g.tolist() for g in got] == [cached.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_rules_have_no_bare_vocabulary(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        config = json.load(file)
    config["normalizer"] = {"type": "NFC"}  # capitals stay
    path = tmp_path / "other.json"
    path.write_text(json.dumps(config), encoding="utf-8")
    cached = CachedTokenizer(str(path))
    assert cached.bare is None
    texts = ["The THE the, a.b", "Café"]
    assert [g.tolist() for g in cached.encode_many(texts)] == [
        cached.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_keeps_its_tokenizer():
    one = tokens.cached_tokenizer(PATH)
    list(one.encode_batch(["some words"]))
    assert tokens.cached_tokenizer(PATH) is one and "words" in one.young
