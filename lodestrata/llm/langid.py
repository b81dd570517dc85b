"""Language identification by segmentation-marginalised unigrams.

A language is a unigram distribution over the pieces of a fixed public vocabulary. The probability of a word is summed over
all its segmentations into pieces by the forward algorithm, and that of a text is the product over its words (no piece
joins characters of two words, so this is the sum over all segmentations of the text). Piece probabilities come from
expectation maximisation with the forward-backward algorithm, for each language, over the word counts of a
sample of labelled texts whose size is bounded by ``DOCS_PER_LANGUAGE``. Prediction covers every whole text.

The pieces that occur in many words are found at once by an automaton and are the edges of one graph of places. Sums run
along it in logarithms, a place at a time in all words, so no word is too long or too rare for them. Memory is bounded by
``BLOCK`` characters: a longer word is summed block by block with the last few places carried over, and a longer word of
the training sample is fitted in parts of that length.

Defined results: ``und`` with score 0 for null texts and texts without a letter; ties go to the language first in code-point
order; without any labelled text everything is ``und``; a null doc_id isn't held out; repeated rows are predicted alike; columns
of the input that bear a result's name are replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WordIndex, crc32_of_id, few, kept, materialize, others, rows_for
from lodestrata.llm.tokens import default_path

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
#: Bound of the training sample: about so many texts of each language, chosen by a hash of the id.
DOCS_PER_LANGUAGE = 1500
ROUNDS = 3
PSEUDO_COUNT = 0.05
#: Characters whose places are in memory at once.
BLOCK = 1 << 16
#: Letters, and numbers that are no digits (of other scripts, fractions, superscripts), which are told apart by ``str.isalpha``.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _words(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Edges:
    """Pieces found in a text: from place ``start`` to place ``to``. Ids from the vocabulary's size on are ``odd`` characters."""

    start: np.ndarray
    to: np.ndarray
    id: np.ndarray
    odd: list[str]


def _along(sums: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
    """sums[target] = log of the sum of exp(sums[source] + weight) over the edges into it, in the order of ``step``."""
    order = np.argsort(step * len(sums) + target)
    source, target, weight, step = source[order], target[order], weight[order], step[order]
    first = np.flatnonzero(np.diff(target, prepend=-1) | np.diff(step, prepend=-1))  # of the edges into one place
    size = np.diff(first, append=len(target))
    turns = np.flatnonzero(np.diff(step[first], prepend=-1))  # of the places of one step
    with np.errstate(divide="ignore"):
        for k, end in zip(turns.tolist(), [*turns[1:].tolist(), len(first)], strict=True):
            begin, last = first[k], first[end] if end < len(first) else len(target)
            terms = sums[source[begin:last]] + weight[begin:last]
            cuts = first[k:end] - begin
            top = np.maximum.reduceat(terms, cuts, axis=0)
            top[np.isneginf(top)] = 0
            total = np.add.reduceat(np.exp(terms - np.repeat(top, size[k:end], axis=0)), cuts, axis=0)
            sums[target[first[k:end]]] = top + np.log(total)


class Lattice:
    """The vocabulary and the forward and backward sums over segmentations of many words at once.

    A character that is no piece by itself can also be read as its UTF-8 bytes, which are pieces.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.size = len(names)
        self.ids = {n: i for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and "\n" not in n}
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.length = np.ones(self.size, dtype=np.int64)
        self.found = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.found.add_word(name, i)
            self.length[i] = len(name)
        self.found.make_automaton()

    def edges(self, text: str) -> Edges:
        """All pieces in ``text``, whose words a newline ends."""
        hits = np.fromiter(chain.from_iterable(self.found.iter(text)), dtype=np.int64).reshape(-1, 2)
        to, ids = hits[:, 0] + 1, hits[:, 1]
        start = to - self.length[ids]
        alone = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") != 10
        alone[start[self.length[ids] == 1]] = False
        where = np.flatnonzero(alone)
        chars = [text[i] for i in where.tolist()]
        odd = {c: self.size + k for k, c in enumerate(dict.fromkeys(chars))}
        own = np.fromiter(map(odd.__getitem__, chars), dtype=np.int64, count=len(chars))
        return Edges(np.concatenate([start, where]), np.concatenate([to, where + 1]), np.concatenate([ids, own]), list(odd))

    def _of_bytes(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")]

    def weights(self, edges: Edges, log_p: np.ndarray) -> np.ndarray:
        """Log probability [edge, language]."""
        if not edges.odd:
            return log_p[edges.id]
        return np.concatenate([log_p[: self.size], [log_p[self._of_bytes(c)].sum(axis=0) for c in edges.odd]])[edges.id]

    @staticmethod
    def _parts(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Words (their numbers, and with the leading mark) in parts of at most ``BLOCK`` characters, those of like length together."""
        order = np.argsort(np.fromiter(map(len, words), dtype=np.int64, count=len(words)), kind="stable")
        begin = held = 0
        for k, w in enumerate(order.tolist()):
            n = len(words[w]) + 2
            if held and held + n > BLOCK:
                yield order[begin:k], ["▁" + words[x] for x in order[begin:k].tolist()]
                begin, held = k, 0
            held += n
        if begin < len(order):
            yield order[begin:], ["▁" + words[x] for x in order[begin:].tolist()]

    @staticmethod
    def _places(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The words in one text, and the first and last place of each."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(n + 1) - 1
        return "\n".join(words) + "\n", end - n, end

    def forward(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """Log probability [word, language] of words that bear the leading mark."""
        text, begin, end = self._places(words)
        edges = self.edges(text)
        sums = np.full((len(text) + 1, log_p.shape[1]), -np.inf)
        sums[begin] = 0
        _along(sums, edges.start, edges.to, self.weights(edges, log_p), edges.to - begin[np.searchsorted(end, edges.to)])
        return sums[end]

    def _long(self, word: str, log_p: np.ndarray) -> np.ndarray:
        """The same sum of one word, block by block."""
        last = np.zeros((1, log_p.shape[1]))  # the sums at the places up to where a block begins
        for k in range(0, len(word), BLOCK):
            back = len(last) - 1
            text = word[k - back : k + BLOCK]
            edges = self.edges(text)
            fresh = edges.to > back
            sums = np.full((len(text) + 1, log_p.shape[1]), -np.inf)
            sums[: back + 1] = last
            _along(sums, edges.start[fresh], edges.to[fresh], self.weights(edges, log_p)[fresh], edges.to[fresh])
            last = sums[-min(len(sums), self.longest) :]
        return last[-1]

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language] for p [piece, language]."""
        out = np.zeros((len(words), p.shape[1]))
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        for at, part in self._parts(words):
            out[at] = self.forward(part, log_p) if len(part[0]) <= BLOCK else [self._long(w, log_p) for w in part]
        return out

    def expected(self, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` times the words, which bear the leading mark."""
        text, begin, end = self._places(words)
        edges = self.edges(text)
        word = np.searchsorted(end, edges.to)
        weight = self.weights(edges, log_p)
        ahead, behind = np.full((len(text) + 1, 1), -np.inf), np.full((len(text) + 1, 1), -np.inf)
        ahead[begin] = behind[end] = 0
        _along(ahead, edges.start, edges.to, weight, edges.to - begin[word])
        _along(behind, edges.to, edges.start, weight, end[word] - edges.start)
        share = np.exp(ahead[edges.start] + weight + behind[edges.to] - ahead[end][word])[:, 0] * counts[word]
        out = np.bincount(edges.id, share, self.size + len(edges.odd))
        for k, c in enumerate(edges.odd):
            np.add.at(out, self._of_bytes(c), out[self.size + k])
        return out[: self.size]

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language."""
        if any(len(w) > BLOCK - 2 for w in words):
            cut = [(w[k : k + BLOCK - 2], n) for w, n in zip(words, counts.tolist(), strict=True) for k in range(0, len(w), BLOCK - 2)]
            words, counts = [w for w, _ in cut], np.array([n for _, n in cut])
        p = np.full(self.size, 1.0 / self.size)
        for _ in range(rounds):
            expected = np.full(self.size, PSEUDO_COUNT)
            for at, part in self._parts(words):
                expected += self.expected(part, counts[at], np.log(p)[:, None])
            p = expected / expected.sum()
        return p


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc32_of_id(column) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str | None = None, per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(doc_id, text, lang) -> languages in code-point order, probabilities [piece, language].

    What comes to the driver is a count and a vector of the vocabulary's size for each language.
    """
    path = path or default_path(VOCABULARY)
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1_000_000)).alias("draw"))
    sizes = labelled.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share"))
    sample = labelled.join(few(materialize(docs.sparkSession, sizes, "languages")), "lang").filter(F.col("draw") < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found: Counter = Counter()
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    found.update((lang, w) for w in _words(text))
                langs, words = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Lattice(path).fit(pdf["word"].tolist(), pdf["n"].to_numpy(float))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.tobytes()]})

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = words.groupBy("lang").applyInPandas(fit, "lang string, p binary").collect()
    models = {r["lang"]: np.frombuffer(r["p"]) for r in fitted}
    langs = sorted(models)
    return langs, np.stack([models[x] for x in langs], axis=1) if langs else np.zeros((0, 0))


class _Scorer:
    def __init__(self, path: str, p: np.ndarray):
        self.lattice, self.p = Lattice(path), p
        self.index, self.scores = WordIndex(), np.zeros((1024, p.shape[1]))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probability [text, language]."""
        out = np.zeros((len(texts), self.p.shape[1]))
        for k in range(0, len(texts), 256):
            split = [_words(t) for t in texts[k : k + 256]]
            new, begin = self.index.add(split)
            self.scores = rows_for(self.scores, begin + len(new))
            self.scores[begin : begin + len(new)] = self.lattice.log_probability(new, self.p)
            for i, ws in enumerate(split, k):
                out[i] = self.scores[self.index.numbers(ws)].sum(axis=0)
        return out


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, path: str | None = None) -> DataFrame:
    """Adds lang_pred and score to the rows of ``docs``, which has a column ``text``; the other columns pass through."""
    path = path or default_path(VOCABULARY)
    docs = docs.select(*others(docs, "lang_pred", "score"))
    held = docs.sparkSession.sparkContext.broadcast(p)  # vocabulary x languages
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs:
            model = held.value
            scorer = kept(("langid", path, hash(model.tobytes())), lambda: _Scorer(path, model))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if has_letter(t)] if langs else []
                if known:
                    ll = scorer.score([texts[i] for i in known])
                    best = ll.argmax(axis=1)
                    score[known] = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, b in zip(known, best.tolist(), strict=True):
                        pred[i] = langs[b]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
