import zlib

import numpy as np
from tokenizers import Tokenizer

from lodestrata.llm import packing, queries
from lodestrata.llm.tokens import default_path, encoder

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, "Don't stop: naïve İstanbul\tΣΑΣ  x\0y <|endoftext|> ok", "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "word " * 5000, "c"),
    (5, "same text", "d"),
    (5, "same text", "d"),
    (6, "z" * 3000 + " end", "e"),
    (None, "no id", "f"),
]


def _ids(text):
    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids + [0]


def _check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_hold_the_tokenizers_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, sequence_id string")
    rows = packing.pack(docs, keep_ids=True).collect()
    got = sorted((r["doc_id"] or -1, r["piece"], r["start"], r["ids"]) for r in rows)
    want = []
    for doc_id, text, _ in ROWS:
        ids = _ids(text)
        want += [(doc_id or -1, k, b, np.array(ids[b : b + 2048], "<u4").tobytes()) for k, b in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert _check_layout(rows, 2048) == 3  # two whole sequences, and one for the rest of the long text and all others


def test_small_cache_gives_the_same_ids():
    texts = [t or "" for _, t, _ in ROWS]
    small = type(encoder(default_path()))(default_path(), most_bytes=600)
    assert small.encode([t.encode() for t in texts]) == [np.array(_ids(t)[:-1], "<u4").tobytes() for t in texts]


def test_odd_words_and_gaps_give_the_same_ids():
    letters = "".join(c for c in map(chr, range(0xAA, 0x250)) if c.isalpha())
    words = [*letters, *(letters[k : k + 4] + "a" for k in range(len(letters))), "e\u0301té", "ÀÉÎ,###", "Ÿa", "ŸÿY", "ﬁn", "word's", "it's'", "don''t", "x<|endoftext|>", "<|endoftext|>", "a1b", "naïve...", "İx", "ΑΣ", "ΑΣ.", "ªº", "µm", "日本", "...", "'", "\u00ad", "$%&Wörd$%&"]
    gaps = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n"]
    texts = ["".join(w + gaps[k % 7] for k, w in enumerate(words)), "\x1c a\x1d b\x1e \x1f c\x85 \xa0d\u2003e\u3000", " lead", "trail ", " ", "", *words, *("a" * n + "é" * n for n in (30, 60, 70, 3000))]
    whole = Tokenizer.from_file(default_path())
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for size in (600, 96 << 20):
        enc = type(encoder(default_path()))(default_path(), most_bytes=size)
        for _ in range(2):
            got = enc.encode([t.encode() for t in texts])
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert enc.encode([None, b"a", None]) == [b"", np.array(_ids("a")[:-1], "<u4").tobytes(), b""] and enc.encode([]) == []


def test_words_of_letters_skip_the_patterns():
    """The normalizer and the patterns took half of the time; only what isn't made of Latin letters goes through them."""
    enc = type(encoder(default_path()))(default_path())
    seen, learn = [], enc._learn
    enc._learn = lambda plain: seen.extend(plain) or learn(plain)
    enc.encode(["Anblewh sttible, athawh; THONRE éaiquement ### Schließlich,### x1 日本".encode()])
    assert sorted(seen) == sorted([b",", b";", b"###", b",###", b"x1", "日本".encode()])


def test_whole_table_is_packed_nearly_full(spark):
    rows = queries.op10_pack_sequences(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    total = 0
    for d in docs:
        total += len(_ids(d["text"]))
    assert sum(r["length"] for r in rows) == total
    assert _check_layout(rows, 2048) <= -(-total // 2048) + 2
    assert all(r["length"] == 2048 or r["piece"] == max(x["piece"] for x in rows if x["doc_id"] == r["doc_id"]) for r in rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_uses_every_piece_once_and_fits():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 40, 257), np.bincount([256] * 9 + [255] * 50, minlength=257), np.bincount([1] * 3000, minlength=257)):
        counts[0] = 0
        used = np.zeros(257, dtype=int)
        for pattern, n in packing.plan(counts, 256):
            assert sum(m * c for m, c in pattern.items()) <= 256
            for m, c in pattern.items():
                used[m] += c * n
        assert (used == counts).all()


def test_best_fit_equals_one_piece_at_a_time():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 65, 300), minlength=65)
    bins = []
    for length in [m for m in range(64, 0, -1) for _ in range(counts[m])]:
        fit = [k for k, left in enumerate(bins) if left >= length]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= length
        else:
            bins.append(64 - length)
    assert sum(n for _, n in packing.best_fit(counts, 64)) == len(bins)
