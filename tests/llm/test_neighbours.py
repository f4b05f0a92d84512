import numpy as np
import pytest

from codeloom.llm import neighbours as nb

SCHEMA = "id string, project_id string, embedding_model string, status string, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as cell", "'h' as h1", "1 as n", "2 as cosine")


def brute(vectors, k):
    ids = sorted(vectors)
    x = np.stack([np.array(vectors[i], float) for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]): s[i, j] for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] > -2}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    return {f"v{i:04}": (centres[i % 60] + 0.25 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(900)}


@pytest.mark.parametrize("bins", [5_000, 150])
def test_recall_against_brute_force(spark, clustered, bins):
    rows = [(i, "p" if n % 10 else "q", "m", "active", v) for n, (i, v) in enumerate(clustered.items())]
    got = {(r.id, r.near) for r in nb.nearest(table(spark, rows), nb.Settings(k=5, dim=16, bin_rows=bins, leaf_rows=20, recall=0.95, cells_visited=6)).collect()}
    truth = set()
    for project in "pq":
        truth |= set(brute({r[0]: r[4] for r in rows if r[1] == project}, 5))
    assert len(got & truth) / len(truth) >= 0.9 and len(got) == len(truth)


def test_threshold_loses_nothing(spark, clustered):
    rows = [(i, "p", "m", "active", v) for i, v in clustered.items()]
    settings = nb.Settings(k=5, dim=16, leaf_rows=20, min_cosine=0.9)
    truth = {tuple(sorted(pair)) for pair, c in brute(clustered, 5).items() if c >= 0.9}
    got = {tuple(r) for r in nb.similar_pairs(table(spark, rows), settings).collect()}
    assert len(got & truth) >= 0.99 * len(truth) and got <= truth


def test_unusable_rows_copies_and_groups(spark):
    v, w = [1.0, 0.0, 0.5], [1.0, 0.1, 0.5]
    rows = [(f"c{i}", "p", "m", "active", v) for i in range(9)] + [("c0", "p", "m", "active", v), ("x", "p", "m", "active", w), ("big", "p", "m", "active", [300.0, 30.0, 150.0])]
    rows += [("n1", "p", "m", "active", None), ("n2", "p", "m", "active", []), ("n3", "p", "m", "active", [1.0]), ("n4", "p", "m", "active", [0.0, 0.0, 0.0]), ("n5", "p", "m", "active", [float("nan"), 1.0, 1.0]), ("n6", "p", "m", "stale", v), (None, "p", "m", "active", v), ("n7", None, "m", "active", v), ("lone", "q", "m", "active", v)]
    near = nb.nearest(table(spark, rows), nb.Settings(k=5, dim=3)).collect()
    by = {}
    for r in near:
        by.setdefault(r.id, []).append(r.near)
    assert set(by) == {*(f"c{i}" for i in range(9)), "x", "big"} and all(len(b) == 5 and len(set(b)) == 5 for b in by.values())
    assert sorted(by["c0"]) == ["c1", "c2", "c3", "c4", "c5"] and sorted(by["c8"]) == ["c0", "c1", "c2", "c3", "c4"] and "big" in by["x"]
    assert nb.nearest(table(spark, rows).limit(0), nb.Settings(dim=3)).count() == 0


def test_a_cell_beyond_its_size_is_cut_into_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    vectors = {f"a{i:03}": (base + 0.01 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(300)}
    rows = [(i, "p", "m", "active", v) for i, v in vectors.items()]
    settings = nb.Settings(k=3, dim=8, bin_rows=20, leaf_rows=10, max_cells=2, recall=0.99)
    got = {(r.id, r.near) for r in nb.nearest(table(spark, rows), settings).collect()}
    truth = set(brute(vectors, 3))
    assert len(got & truth) / len(truth) >= 0.95


def test_cells_are_visited_until_the_recall_is_met(spark):
    rng = np.random.default_rng(9)
    vectors = {f"v{i:04}": rng.normal(size=12).astype(np.float32).tolist() for i in range(1_200)}
    rows = [(i, "p", "m", "active", v) for i, v in vectors.items()]
    truth = set(brute(vectors, 5))
    for cells in (12, 40):
        settings = nb.Settings(k=5, dim=12, bin_rows=2 * len(rows) // cells, leaf_rows=20, recall=0.93)
        got = {(r.id, r.near) for r in nb.nearest(table(spark, rows), settings).collect()}
        assert len(got & truth) / len(truth) >= 0.93 and len(got) == len(truth)
