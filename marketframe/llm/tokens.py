"""Token ids of whole texts by the public tokenizers."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Iterator
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held by each of the cache's two generations; new words in a call.
GENERATION, LINE = 300_000, 256
#: Bytes of text looked up at a time; kinds of marks behind words that are held.
BATCH, TAILS = 1 << 23, 10_000
#: Marks that may end a word; with letters before them they are a word of their own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters below the combining marks stay as they are when composed; all but
#: a few have one such character as their lower case, whatever stands beside them.
_PLAIN = 0x300
_KINDS = {c: category(c)[0] for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, _PLAIN)))
          if c != "\xad" and len(c.lower()) == 1 and ord(c.lower()) < _PLAIN}
_CLASS = {kind: re.escape("".join(c for c, k in _KINDS.items() if k == kind)) for kind in "LN"}
_IS_PLAIN = re.compile(f"[{re.escape(''.join(_KINDS))}]+")
_UNSURE = r"[\x{130}\x{300}-\x{10FFFF}]"
#: The rules that ``CachedTokenizer`` knows, and their splitting of plain lower-case pieces.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_RULES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
          {"type": "Split", "pattern": {"Regex": _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
           "behavior": "Removed", "invert": True},
          {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
_SPLIT_PLAIN = re.compile(f"{_ENDINGS}|[{_CLASS['L']}]+|[{_CLASS['N']}]|[^{_CLASS['L']}{_CLASS['N']}]+")
#: First UTF-8 byte of the characters from ``_PLAIN`` on, and all later ones.
_WIDE = chr(_PLAIN).encode()[0]
#: First UTF-8 bytes up to the accents'.
_ACCENTS = "\u036f".encode()[0]
#: Name under which a worker process keeps its tokenizer.
_HELD = "marketframe_tokenizer"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible
    Latin-1 characters for themselves, the others numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Letters of a byte-level vocabulary for UTF-8 text decoded as Latin-1; spaces stay.
_SPELT = {b: letter for letter, b in _byte_of().items() if b != 32}


def _spelt(text: str) -> str:
    return text.encode().decode("latin-1").translate(_SPELT)


def _having(at: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each text (its bytes begin at ``at``) has a byte that is ``found``."""
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, np.flatnonzero(found), "right") - 1] = True
    return out


class CachedTokenizer:
    """Ids of a vocabulary with word ends, which drops white space: the ids of a
    text are the ids of its pieces between spaces, joined.  Pieces seen before
    are looked up, new ones go to the tokenizer many at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Ids of marks behind letters; None where they are no word of their own.
        self.tails: dict[str, bytes | None] = {}
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        rules = [*(config["normalizer"] or {}).get("normalizers", []),
                 *(config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        #: The same vocabulary for words split and spelt here; none where its rules are others.
        self.bare = None
        if rules == _RULES:
            config.update(normalizer=None, pre_tokenizer={"type": "WhitespaceSplit"}, added_tokens=[])
            self.bare = Tokenizer.from_str(json.dumps(config))

    def _tail(self, marks: str) -> bytes | None:
        if marks not in self.tails:
            if len(self.tails) >= TAILS:
                self.tails = {}
            ids, both, head = self._encode([marks, "a" + marks, "a"]) if len(marks) <= 8 else (b"", b"", b"a")
            self.tails[marks] = ids if both == head + ids else None
        return self.tails[marks]

    def _lines(self, pieces: list[str], places: list[int], bare: bool, out: list[bytes | None]) -> None:
        """Fills the ids of the pieces at ``places``, sent ``LINE`` at a time as
        one line and told apart by the ends of their words.  The bare vocabulary
        gets words as the rules leave them; for the other a piece is one word."""
        groups = [places[k:k + LINE] for k in range(0, len(places), LINE)]
        if not groups:
            return
        lines, counts = [], []
        for group in groups:
            texts = [pieces[i] for i in group]
            count = np.ones(len(group), np.int64)
            if bare:
                texts = [p if p.isalpha() else _SPLIT_PLAIN.findall(p) for p in " ".join(texts).lower().split(" ")]
                for k, words in enumerate(texts):
                    if type(words) is list:
                        texts[k], count[k] = " ".join(words), len(words)
            line = " ".join(texts)
            lines.append(_spelt(line) if bare else line)
            counts.append(np.cumsum(count))
        tokenizer = self.bare if bare else self.tokenizer
        for group, count, line in zip(groups, counts, tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(line.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != count[-1]:
                continue  # one of them is no single word to this vocabulary
            raw, first = ids.tobytes(), 0
            for i, end in zip(group, (ends[count - 1] * self.dtype.itemsize).tolist()):
                out[i], first = raw[first:end], end

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if self.bare and _IS_PLAIN.fullmatch(p)]
        self._lines(pieces, plain, True, out)
        self._lines(pieces, [i for i, ids in enumerate(out) if ids is None and pieces[i].isalpha()], False, out)
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(left, self.tokenizer.encode_batch_fast([pieces[i] for i in left], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        out = list(map(self.young.get, pieces))
        places = [i for i, ids in enumerate(out) if ids is None]
        missing = [pieces[i] for i in places]
        found = list(map(self.old.get, missing))
        encoded = iter(self._encode([p for p, ids in zip(missing, found) if ids is None]))
        found = [next(encoded) if ids is None else ids for ids in found]
        for i, ids in zip(places, found):
            out[i] = ids
        if len(self.young) + len(missing) > GENERATION:
            self.old, self.young = self.young, dict(zip(pieces, out))
        else:
            self.young.update(zip(missing, found))
        return out

    def _pieces(self, values: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """(ids of the pieces and of marks behind them, in turn; place there of
        each piece and the end).  Letters followed by marks have the ids of both."""
        heads = pc.utf8_rtrim(values, MARKS)
        n_marks = (pc.binary_length(values).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int32)
        marked = np.flatnonzero(n_marks)
        sizes = n_marks[marked]
        cuts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)), dtype=np.int32)
        ends = np.frombuffer(values.buffers()[1], np.int32, len(values), values.offset * 4 + 4)[marked]
        at = np.arange(cuts[-1], dtype=np.int32) + np.repeat(ends - cuts[1:], sizes)
        raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at]
        marks = pa.StringArray.from_buffers(len(marked), pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        tails = [self._tail(m) for m in marks.dictionary.to_pylist()]
        heads = heads.dictionary_encode()
        names, place = heads.dictionary, heads.indices.to_numpy().astype(np.int32)
        # letters that are letters still when composed and lower-cased
        fit = pc.utf8_is_alpha(names).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(fit & pc.match_substring_regex(names, _UNSURE).to_numpy(zero_copy_only=False)).tolist():
            fit[i] = normalize("NFC", names[i].as_py()).lower().isalpha()
        apart = fit[place[marked]] & np.array([t is not None for t in tails], bool)[marks.indices.to_numpy()]
        # all others keep their marks
        whole = values.take(pa.array(marked[~apart])).dictionary_encode()
        used = np.zeros(len(names), bool)
        place[marked[~apart]] = len(names) + whole.indices.to_numpy()
        used[place[place < len(names)]] = True
        # no head ends with a mark, so all these are different
        texts = pc.filter(names, pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        n_whole = len(whole.dictionary)
        ids = self._looked_up(texts + whole.dictionary.to_pylist())
        found = np.full(len(names), b"", object)
        found[used] = ids[:len(texts)]
        table = pa.array([*found.tolist(), *ids[len(texts):], *(t or b"" for t in tails)], pa.large_binary())
        first = np.arange(len(values) + 1, dtype=np.int32)
        behind = np.zeros(len(values) + 1, np.int32)
        behind[marked[apart] + 1] = 1
        first += np.cumsum(behind, dtype=np.int32)
        order = np.empty(first[-1], np.int32)
        order[first[:-1]] = place
        order[first[marked[apart]] + 1] = len(names) + n_whole + marks.indices.to_numpy()[apart]
        return table.take(pa.array(order)), first

    def _plain(self, texts: pa.StringArray) -> pa.StringArray:
        """The texts with spaces for line ends and, where no character from
        ``_PLAIN`` on may compose with them, small letters for capitals A-Z."""
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].copy()
        at = at - at[0]
        if self.bare:
            kept = np.repeat(_having(at, raw >= _WIDE), np.diff(at))
            raw += (((raw - np.uint8(65)) < 26) & ~kept).view(np.uint8) << np.uint8(5)
        raw[raw == 10] = 32
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(raw))

    def _composed(self, texts: pa.StringArray) -> pa.StringArray:
        """Texts of Latin letters and accents with the accents composed, as the
        tokenizer does first."""
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        mask = _having(at - at[0], raw >= _WIDE) & ~_having(at - at[0], raw > _ACCENTS)
        if not self.bare or not mask.any():
            return texts
        mask = pa.array(mask)
        composed = [normalize("NFC", t) for t in texts.filter(mask).to_pylist()]
        return pc.replace_with_mask(texts, mask, pa.array(composed, pa.string()))

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, worked out for about ``BATCH`` bytes at a time;
        null texts have none."""
        column = pc.fill_null(column.cast(pa.string()), "")
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)))
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + BATCH, "right")) - 1)
            pieces = pc.split_pattern(self._plain(self._composed(column.slice(first, last - first))), " ")
            ids, places = self._pieces(pieces.values)
            cuts = np.frombuffer(ids.buffers()[1], np.int64)[places[pieces.offsets.to_numpy()]] // self.dtype.itemsize
            joined = np.frombuffer(ids.buffers()[2] or b"", self.dtype, cuts[-1])
            yield from (joined[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            first = last

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """``encode_column`` of a list."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        return list(self.encode_batch(texts))


def cached_tokenizer(path: str) -> CachedTokenizer:
    """The worker process's tokenizer of the file at ``path`` with the pieces
    seen so far, whatever task asks: functions arrive with modules of their own."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__
    stat = os.stat(path)
    key = path, stat.st_mtime_ns, stat.st_size
    if held.get("key") != key:
        held["tokenizer"], held["key"] = CachedTokenizer(path), key
    return held["tokenizer"]


#: Fixed value: where a byte-level vocabulary splits texts into words.
_SPLIT = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of a task that are compared with the vocabulary's own library first.
COMPARED = 32


class ByteLevelTokenizer:
    """Ids of a byte-level vocabulary file.  The file and the ids are those of
    the tokenizers library; merging is done by tiktoken, which is several times
    faster on texts full of new words.  The first texts of a task go through
    both; where they differ, tokenizers does all of them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special}
        byte = _byte_of()
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in self.tokenizer.get_vocab().items()
                 if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.left = COMPARED

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None:
            return self._slow(text)
        ids = self.fast.encode_to_numpy(text, disallowed_special=())
        if self.left:
            self.left -= 1
            own = self._slow(text)
            if not np.array_equal(ids, own):
                self.fast, ids = None, own
        return ids
