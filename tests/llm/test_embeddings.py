import numpy as np
import pytest

from lodestrata.llm import embeddings, queries

SF = "/root/testdata/sf0.01"


def _brute(ids, vectors):
    n = len(ids)
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    label = list(range(n))
    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    old, new = label[j], label[i]
                    label = [new if x == old else x for x in label]
    least = {}
    for i in range(n):
        least[label[i]] = min(least.get(label[i], ids[i]), ids[i])
    return sorted((ids[i], links[i], least[label[i]], ids[i] == least[label[i]]) for i in range(n))


@pytest.mark.parametrize(("leaf", "part"), [(1000, 4096), (10, 7), (3, 50)])
def test_equals_brute_force(spark, leaf, part):
    rng = np.random.default_rng(leaf)
    vectors = []
    for _ in range(12):
        base = rng.normal(size=20)
        vectors.append(base)
        for _ in range(int(rng.integers(0, 9))):  # about the threshold, in chains, scaled
            base = base / np.linalg.norm(base) + rng.normal(size=20) * rng.choice([0.01, 0.05, 0.07])
            vectors.append(base * rng.choice([0.5, 1, 3]))
    vectors = [np.float32(v).tolist() for v in vectors]
    vectors += [vectors[0], vectors[0], vectors[3], [0.0] * 20, None, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19, [None] + [1.0] * 19, [1.0, 2.0], [2.0, 4.0], [], [1e-30] * 20, [1e30] * 20]
    ids = [int(k) for k in rng.permutation(len(vectors))]
    table = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))], "vec_id long, embedding array<float>, weight int")
    got = embeddings.near_duplicates(table, leaf=leaf, part=part).select("vec_id", "n_links", "component_id", "kept").collect()
    want = _brute(ids, vectors)
    assert sorted(map(tuple, got)) == want
    assert len({c for _, _, c, _ in want}) < len(want) * 0.7


def test_whole_table(spark):
    got = {r["vec_id"]: r for r in queries.op2_embedding_dedup(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert [got[r["vec_id"]]["n_links"] for r in rows] == links.tolist()


def test_repeated_ids_and_no_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table).collect()]
    assert [x for x in got if x[0] is None] == [(None, 2, 1, False)]
    assert sorted(x for x in got if x[0] is not None) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False)]
    alone = embeddings.near_duplicates(table.filter("vec_id is null")).first()
    assert (alone["n_links"], alone["component_id"], alone["kept"]) == (0, None, False)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_boxes_within_reach_are_all_found():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) / 8
    tree = embeddings.Tree(x[:100], 5)
    home, (row, box) = tree.home(x), tree.reach(x, 0.01)
    met = set(zip(row.tolist(), box.tolist(), strict=True))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.01
    assert len(set(home.tolist())) > 20
    assert all((i, home[j]) in met for i, j in np.argwhere(near).tolist())


def test_no_vector_is_copied_for_boxes_or_other_parts(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(k, 1, np.float32(v).tobytes(), 16) for k, v in enumerate(rng.normal(size=(600, 16)))], "class_id long, weight long, raw binary, dims int")
    packs = embeddings._packs(table, 100).collect()
    assert len(packs) == 6
    assert sorted(i for p in packs for i in np.frombuffer(p["ids"], np.int64).tolist()) == list(range(600))
    assert sum(len(p["cells"]) for p in packs) == 600 * 16 * 4
