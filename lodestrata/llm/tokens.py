"""Whole texts to token ids, one cached word at a time.

The default vocabulary's pre-tokenizer drops white space and never joins characters across it, so the ids of a text are the
ids of its space-separated words in order. A worker keeps the ids of words it has met, as bytes, in a cache of bounded bytes:
most words of a corpus repeat. Arrow splits texts, numbers the distinct words of a batch and puts their ids in the order of the
words, so that Python meets each distinct word of a batch once. Words of lower-case Latin letters, most of those that
are new, are left by its normalizer and its patterns as they are, so they go to its merges without them. A tokenizer that is
loaded is asked whether this holds for it (``_probe``); one for which it doesn't gets whole texts.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestrata.llm.common import kept

_MARKS = string.punctuation
#: Lower-case Latin letters: they have one form in every normal form that composes, and none is lowered further.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())


#: Bytes of words that a worker keeps in each of two generations.
CACHE_BYTES = 96 << 20


def encoder(path: str, most_bytes: int = CACHE_BYTES) -> WordEncoder:
    return kept(("tokens", path, most_bytes), lambda: WordEncoder(path, most_bytes))


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _values(array: pa.Array) -> list[bytes]:
    """The values of a string array without nulls, in UTF-8; ``to_pylist`` takes ten times as long."""
    offsets, raw = np.frombuffer(array.buffers()[1], "<i4")[array.offset :][: len(array) + 1].tolist(), array.buffers()[2]
    raw = raw.to_pybytes() if raw else b""
    return [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _lower(word: bytes) -> bytes:
    """A word of Latin letters in lower case; empty for any other."""
    if word.isalpha():
        return word.lower()
    if word.isascii():
        return b""
    text = word.decode()
    return text.lower().encode() if text.isalpha() and max(text) <= "\xff" else b""


class WordEncoder:
    """Words met lately are kept in two generations of at most ``most_bytes`` each, about: when the young one is full it becomes the
    old one, and words that are met again move back. Words longer than ``longest`` bytes aren't kept."""

    #: What an entry takes beside a word and its ids, about.
    entry_bytes = 190

    def __init__(self, path: str, most_bytes: int = CACHE_BYTES, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_bytes, self.longest, self.held = most_bytes, longest, 0
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._probe()

    def _probe(self) -> None:
        """What this tokenizer allows: ids word by word, a NUL as a mark between words, words without their case and marks, and
        words of letters without its normalizer and its patterns."""
        ids, mark = self._ids, np.frombuffer(self._ids("\0"), "<u4")
        self.mark_id = int(mark[0]) if len(mark) == 1 else -1
        pairs = [("the", "Words"), ("a1", "'s"), ("é", "\u65e5\u672c"), ("x.", ".y"), ("\0", "z")]
        self.by_word = self.mark_id >= 0 and all(ids(f"{gap}{a}{gap}{b}{gap}") == ids(a) + ids(b) for a, b in pairs for gap in (" ", "\n", " \t"))
        self.by_parts = all(ids("Wörd" + m * n) == ids("wörd") + ids(m * n) for m in [*_MARKS, _MARKS] for n in (1, 2))
        letters = [*_LETTERS, *(_LETTERS[k : k + 5] + _LETTERS[k % 26] for k in range(len(_LETTERS))), "thingenan", "schließlich", "rétention"]
        self.plain = self._without_patterns()
        if self.plain and any(b != ids(w.decode()) for w, b in self._learn_letters([w.encode() for w in letters]).items()):
            self.plain = None

    def _without_patterns(self):
        """The tokenizer's merges alone, if they mark the ends of words; ``ends`` tells which ids do."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        suffix = isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.model.end_of_word_suffix
        if not suffix or not self.by_parts:
            return None
        plain = Tokenizer.from_str(self.tokenizer.to_str())
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = plain.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        return plain

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, plain: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, many in a call: a NUL stands between them and tells them apart afterwards."""
        found = {}
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            ids = np.array(self.tokenizer.encode_batch_fast([b" \0 ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(part) - 1:
                raise AssertionError("a mark was lost between words")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, [*(at * 4).tolist(), len(raw)], strict=True):
                found[word] = raw[begin:end]
                begin = end + 4
        return found

    def _learn_letters(self, plain: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of lower-case Latin letters; the last of a word's ids says that it ends."""
        found = {}
        for k in range(0, len(plain), 512):
            part = plain[k : k + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise AssertionError("the end of a word was lost")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, (ends * 4).tolist(), strict=True):
                found[word] = raw[begin:end]
                begin = end
        return found

    def _look_up(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't in the young generation."""
        found, split, learn, letters, marks = {}, {}, set(), set(), _MARKS.encode() if self.by_parts else b""
        missed = []
        for w, ids in zip(new, map(self.old.get, new), strict=True):
            if ids is not None:
                found[w] = ids
            elif w:
                missed.append(w)
            else:  # what white space at an end of a text leaves
                found[w] = b""
        for w in missed:
            # the vocabulary is of lower case and splits letters from marks: "Word," has the ids of "word" and ","
            core = w.rstrip(marks) if marks else b""
            low = _lower(core)
            if low and low != w:
                split[w] = low, mark = low, w[len(core) :]
                if low not in self.known and low not in found:
                    letters.add(low)
                if mark and mark not in self.known and mark not in found:
                    learn.add(mark)
            elif b"\0" in w or len(w) > self.longest:
                found[w] = self._ids(w.decode())
            else:
                (letters if low else learn).add(w)
        for parts in (letters, learn):
            old = {w: ids for w in parts if (ids := self.old.get(w)) is not None}
            parts.difference_update(old)
            found |= old
        found |= self._learn_letters(list(letters)) if self.plain else self._learn(list(letters))
        found |= self._learn(list(learn))
        for w, (low, mark) in split.items():
            parts = [found[x] if x in found else self.known[x] for x in (low, mark) if x]
            found[w] = b"".join(parts)
        return found

    def encode(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        """The ids of each text (UTF-8) as little-endian unsigned 32-bit integers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_word:
            return [self._ids(t or "") for t in texts.to_pylist()]
        out = []
        for k in range(0, len(texts), 1024):
            split = pc.ascii_split_whitespace(texts[k : k + 1024])
            numbered = split.flatten().cast(pa.string()).dictionary_encode()
            distinct = _values(numbered.dictionary) if len(numbered) else []
            ids = list(map(self.known.get, distinct))
            new = [w for w, b in zip(distinct, ids, strict=True) if b is None]
            found = self._look_up(new) if new else {}
            ids = pa.array([found[w] if b is None else b for w, b in zip(distinct, ids, strict=True)], pa.large_binary()).take(numbered.indices)
            short = {w: b for w, b in found.items() if len(w) <= self.longest}
            self.known.update(short)
            self.held += sum(map(len, short)) + sum(map(len, short.values())) + self.entry_bytes * len(short)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = [0, *np.frombuffer(ids.buffers()[1], "<i8")[ids.offset :][ends].tolist()] if len(ids) else [0] * (len(ends) + 1)
            raw = memoryview(ids.buffers()[2] or b"")
            out += [raw[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            if self.held > self.most_bytes:
                self.known, self.old, self.held = {}, self.known, 0
        return out
