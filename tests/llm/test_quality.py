import hashlib
import zlib
from collections import Counter

import numpy as np
import xxhash

from lodestrata.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_held_out_separation(spark):
    got = queries.op8_quality_score(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert len(bad) > 50
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean() > 0.98
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.15
    assert got.doc_id.is_unique and got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_features_are_words_pairs_and_shapes():
    (at, n), (none, zero) = quality.Hasher().features([b"One two  two\nOne two", None])
    assert n == 5 and len(at) == 5 * 2 + 4 * 2 and zero == 0 and len(none) == 0
    small = quality.Hasher()
    small.index.most_bytes = 200
    again = [b for b, _ in small.features([b"One two  two\nOne two", None])]
    assert (again[0] == at).all()
    assert quality._shape("SHOUT!!!") == quality._shape("NO!!") == "X!"


def test_update_equals_the_textbook_step():
    model, at, x = quality.Ftrl(3), np.array([0, 2, 3]), np.array([1.0, 0.5, 1.0])
    z, n = np.zeros(4), np.zeros(4)
    for label in (1, 0, 1, 1):
        w = np.array([0 if abs(zi) <= quality.L1 else -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + ni**0.5) / quality.ALPHA + quality.L2) for zi, ni in zip(z, n, strict=True)])
        prob = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (prob - label) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
        model.update(at, x, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def _plain_features(text):
    """Hashes of words, shapes and neighbouring pairs, one by one."""
    words, out, whole = (text or "").split(), Counter(), 2**64 - 1
    hashed = [(xxhash.xxh64_intdigest(w.encode()), xxhash.xxh64_intdigest("\0" + quality._shape(w))) for w in words]
    for pair in hashed:
        out.update(h % quality.BUCKETS for h in pair)
    for a, b in zip(hashed, hashed[1:], strict=False):
        for x, y in zip(a, b, strict=True):
            m = (x * 0x9E3779B97F4A7C15 & whole) ^ (y >> 7) ^ y
            out[(m ^ (m >> 29)) % quality.BUCKETS] += 1
    return {at: n / max(1, len(words)) ** 0.5 for at, n in out.items()}


def test_the_query_equals_a_plain_version(spark):
    """Training in the stated order and scoring, coordinate by coordinate."""
    texts = ["good plain words here", "BUY NOW!!! 777 888", "some other plain words", "CLICK!!! 999", "", None, "x" * 100 + "Y" * 50 + " end"]
    docs = [(k, texts[k % len(texts)]) for k in range(40)]
    labels = [(k, int(k % len(texts) in (0, 2, 4))) for k in range(0, 40, 2)] + [(3, None), (99, 1)]
    weights = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    z, n, w = Counter(), Counter(), {}
    weigh = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    seen = [(hashlib.md5(f"{i}/{q}".encode()).hexdigest(), q, texts[i % len(texts)]) for i, q in labels if q is not None and i < 40 and zlib.crc32(str(i).encode()) % 5]
    for _, label, text in sorted(seen, key=lambda r: r[0]):
        x = _plain_features(text) | {quality.BUCKETS: 1.0}
        p = 1 / (1 + np.exp(-sum(weigh(i) * v for i, v in x.items())))
        w = {i: weigh(i) for i in x}
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
            n[i] += g * g
    assert len(seen) > 10 and np.allclose([weights[i] for i in z], [weigh(i) for i in z], atol=1e-5)
    for r in quality.score(spark.createDataFrame(docs, "doc_id long, text string"), weights).collect():
        dot = sum(weigh(i) * v for i, v in _plain_features(r["text"]).items()) + weigh(quality.BUCKETS)
        assert np.isclose(r["score"], 1 / (1 + np.exp(-dot)), atol=1e-5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "ok " * 9000, "c"), (3, "ok", "c"), (None, "text", "d")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 1), (3, 1, 1), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    untaught = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels.limit(0))).collect()
    assert {r["score"] for r in untaught} == {0.5}
    named = quality.score(docs.selectExpr("text", "1 as SCORE", "doc_id"), np.zeros(quality.BUCKETS + 1))
    assert named.columns == ["text", "doc_id", "score"] and {r["score"] for r in named.collect()} == {0.5}
    assert [r[0] for r in docs.filter("doc_id is null").select(quality.held_out()).collect()] == [False]
    assert quality.score(docs.limit(0).select("text"), np.zeros(quality.BUCKETS + 1)).count() == 0
