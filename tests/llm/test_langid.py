import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import langid, queries
from lodestrata.llm.tokens import default_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lattice():
    return langid.Lattice(default_path(langid.VOCABULARY))


def _brute(lattice, word, p):
    """Every segmentation, one by one."""
    if not word:
        return np.ones(p.shape[1])
    total = np.zeros(p.shape[1])
    for k in range(1, len(word) + 1):
        if word[:k] in lattice.ids:
            total = total + p[lattice.ids[word[:k]]] * _brute(lattice, word[k:], p)
    if word[0] not in lattice.ids:
        total = total + p[[lattice.bytes[b] for b in word[0].encode()]].prod(axis=0) * _brute(lattice, word[1:], p)
    return total


def test_forward_sums_all_segmentations(lattice):
    p = np.random.default_rng(0).dirichlet(np.ones(lattice.size), 3).T
    words = ["the", "tionthe", "straße", "a", "ꙮx", "日本語", "x\U0001f600y", "ththehanerin"]
    want = np.log([_brute(lattice, "▁" + w, p) for w in words])
    assert np.allclose(lattice.log_probability(words, p), want)


def _place_by_place(lattice, word, p):
    """The same sum in logarithms, one place after another."""
    sums = [np.zeros(p.shape[1])]
    for j in range(1, len(word) + 1):
        terms = [sums[i] + np.log(p[lattice.ids[word[i:j]]]) for i in range(max(0, j - lattice.longest), j) if word[i:j] in lattice.ids]
        if word[j - 1] not in lattice.ids:
            terms.append(sums[-1] + np.log(p[lattice._of_bytes(word[j - 1])]).sum(axis=0))
        sums.append(np.logaddexp.reduce(terms))
    return sums[-1]


def test_words_of_every_length_and_script(lattice, monkeypatch):
    p = np.stack([lattice.fit(words, np.array([1.7e6, 3.4e7])) for words in (["the", "and"], ["der", "und"])], axis=1)
    units = ["z", "reading", "\ua66e", "\U0001f600", "日本", "aꙮ", "é"]
    words = [(u * n)[:n] for u in units for n in (1, 20, 23, 24, 25, 199, 201, 2500)]
    want = [_place_by_place(lattice, "▁" + w, p) for w in words]
    got = lattice.log_probability(words, p)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-12)
    monkeypatch.setattr(langid, "BLOCK", 50)  # words of more than one block
    assert np.allclose(lattice.log_probability(words, p), want, rtol=1e-12)


def _counts_by_enumeration(lattice, word, p):
    """Expected pieces of a word: every segmentation with its share."""
    found = []

    def walk(k, pieces, q):
        if k == len(word):
            found.append((pieces, q))
        for end in range(k + 1, len(word) + 1):
            if word[k:end] in lattice.ids:
                i = lattice.ids[word[k:end]]
                walk(end, [*pieces, i], q * p[i])
        if k < len(word) and word[k] not in lattice.ids:
            own = lattice._of_bytes(word[k])
            walk(k + 1, [*pieces, *own], q * p[own].prod())

    walk(0, [], 1.0)
    total, out = sum(q for _, q in found), np.zeros(lattice.size)
    for pieces, q in found:
        np.add.at(out, pieces, q / total)
    return out


def test_fit_equals_em_by_enumeration(lattice):
    words, counts = ["the", "there", "ꙮthe", "日x", "other"], np.array([9.0, 3, 2, 1, 1])
    p = np.full(lattice.size, 1 / lattice.size)
    for _ in range(2):
        expected = sum(n * _counts_by_enumeration(lattice, "▁" + w, p) for w, n in zip(words, counts, strict=True)) + langid.PSEUDO_COUNT
        p = expected / expected.sum()
    assert np.allclose(lattice.fit(words, counts, 2), p, rtol=1e-9)


def test_long_words_are_fitted(lattice, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 300)
    p = lattice.fit(["ba" * 1000, "the"], np.array([5.0, 1.0]))
    assert np.isclose(p.sum(), 1) and p[[lattice.ids[x] for x in ("ba", "aba") if x in lattice.ids]].sum() > 0.1


def test_the_query_equals_a_plain_version(spark, lattice):
    """Training and prediction of small rows, with the sums and the fit taken place by place."""
    texts = [("the and of that there", "en"), ("der die und das dort", "de"), ("the\u00a0and\u2003then", "en"), ("UND İST das", "de"), ("und then", "en"), ("das there", "de")]
    rows = [(k, *texts[k % len(texts)]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = langid.train(docs)
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for k, lang in enumerate(langs):
        counts = Counter(w for _, t, x in seen if x == lang for w in t.lower().split())
        assert np.allclose(p[:, k], lattice.fit(list(counts), np.array(list(counts.values()), dtype=float)), rtol=1e-9)
    for r in langid.identify(docs, langs, p).collect():
        ll = sum(_place_by_place(lattice, "▁" + w, p) for w in r["text"].lower().split())
        assert r["lang_pred"] == langs[int(ll.argmax())] and np.isclose(r["score"], 1 / np.exp(ll - ll.max()).sum())


def test_ties_clashing_names_and_ids(spark):
    p = langid.Lattice(default_path(langid.VOCABULARY)).fit(["the"], np.array([3.0]))
    docs = spark.createDataFrame([(None, "the", 7, "x"), (3, "ꙮ", 8, "y")], "doc_id long, text string, Score int, LANG_PRED string")
    out = langid.identify(docs, ["a", "b"], np.stack([p, p], axis=1))
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [(r["lang_pred"], r["score"]) for r in out.collect()] == [("a", 0.5)] * 2
    assert [r[0] for r in docs.select(langid.held_out()).collect()] == [False, zlib.crc32(b"3") % 4 == 2]


def test_runs_of_unseen_characters_are_scored(lattice):
    p = np.stack([lattice.fit(words, np.array([4e5, 3e5])) for words in (["the", "and"], ["der", "und"])], axis=1)
    runs = [c * n for c in ("\U0001f600", "\U00020000", "\ua66e") for n in range(1, 31)]
    words = runs + ["the" + w for w in runs[:20]]
    got = lattice.log_probability(words, p)
    assert np.isfinite(got).all()
    assert np.allclose(got, [_place_by_place(lattice, "▁" + w, p) for w in words])


def test_a_run_of_unseen_characters_decides_nothing(spark, lattice):
    p = np.stack([lattice.fit(words, np.array([4e5, 3e5])) for words in (["the", "and"], ["der", "und"])], axis=1)
    texts = [f"{text} {c * n}" for c in ("\U0001f600", "\ua66e") for n in range(12, 24) for text in ("the and the and the", "der und der und der")]
    rows = langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), ["a", "b"], p).collect()
    assert all(r["lang_pred"] == ("a" if r["text"].startswith("the") else "b") and 0.5 <= r["score"] <= 1 for r in rows)


def test_em_raises_the_likelihood(lattice):
    words, counts = ["the", "there", "then", "other", "ꙮthe"], np.array([9.0, 3, 3, 2, 1])
    ll = []
    for rounds in (1, 2, 4):
        p = lattice.fit(words, counts, rounds)[:, None]
        ll.append((lattice.log_probability(words, p)[:, 0] * counts).sum())
        assert np.isclose(p.sum(), 1)
    assert ll[0] < ll[1] < ll[2]


def test_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == len(docs) and len(both) > 150
    assert (both.lang == both.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !?", "de"), (4, "the and of that", "en"), (5, "der die und das", "de"), (5, "der die und das", "de"), (9, "the of the and", None), (None, "the and", "en"), (8, "x" * 4000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'extra' as score_note")
    langs, p = langid.train(docs)
    assert langs == ["de", "en"] or langs == ["de"] or langs == ["en"]
    out = langid.identify(docs.select("doc_id", "text"), langs, p).collect()
    assert len(out) == len(rows)
    assert [r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in out)


def test_numbers_of_any_script_are_no_letters(spark):
    texts = ["² ½ Ⅷ", "①②", "٣ 三 x"[:2], "೬", "_ _", "Ⅷ a", "三", "ª", "\u0301"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(["the and of that"] * 9)], "doc_id long, text string")
    langs, p = langid.train(docs.selectExpr("*", "'en' as lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langs, p).collect()}
    assert [got[k] == ("und", 0.0) for k in range(len(texts))] == [True, True, True, True, True, False, False, False, True]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    langs, p = langid.train(docs)
    assert langs == [] and langid.identify(docs.select("doc_id", "text"), langs, p).first()["lang_pred"] == "und"
    empty = docs.limit(0)
    assert langid.identify(empty.select("doc_id", "text"), *langid.train(empty)).count() == 0
