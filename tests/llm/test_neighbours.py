import numpy as np
import pytest

from lodeline.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame(rows, "c string, id string, v array<float>")


def brute(x, k):
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_estimates_stay_within_bounds():
    x = neighbours.unit(np.random.default_rng(1).standard_normal((600, 64))).astype(np.float32)
    centre, turn = x.mean(axis=0), neighbours.rotation(64)
    guess, bound = neighbours.estimate(neighbours.encode(x, centre, turn), x[:200], centre, turn)
    assert np.mean(np.abs(guess - x[:200] @ x.T) <= bound + 0.02) > 0.93
    assert np.abs(guess - x[:200] @ x.T).mean() < 0.09


@pytest.mark.parametrize("cells,least", [(1, 0.995), (12, 0.9)])
def test_recall(spark, cells, least):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((12, 64))[rng.integers(0, 12, 1500)] + 0.9 * rng.standard_normal((1500, 64))).astype(np.float32)
    got = neighbours.nearest_vectors(frame(spark, [("c", f"{i:05d}", v.tolist()) for i, v in enumerate(x)]), "c", "id", "v", cells=cells).collect()
    _, want = brute(x, 5)
    pairs = {(int(r.id), int(r.neighbour)) for r in got}
    assert np.mean([(i, j) in pairs for i in range(len(x)) for j in want[i]]) >= least
    assert len(got) == 5 * len(x) and all(abs(r.cosine) <= 1 for r in got)


def test_copies_and_dirt(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(64).tolist(), rng.standard_normal(64).tolist()
    rows = [("c", f"a{i}", a) for i in range(9)] * 2 + [("c", "b", b), ("d", "z", a), (None, "n", a), ("c", None, a), ("c", "nan", [float("nan")] * 64), ("c", "inf", [float("inf")] * 64), ("c", "zero", [0.0] * 64), ("c", "short", [1.0]), ("c", "null", None), ("c", "part", [None] + [1.0] * 63)]
    got = neighbours.nearest_vectors(frame(spark, rows), "c", "id", "v").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        by.setdefault((r.scope, r.id), []).append(r.neighbour)
    assert by["c", "a0"] == ["a1", "a2", "a3", "a4", "a5"] and by["c", "a8"] == ["a0", "a1", "a2", "a3", "a4"] and by["c", "b"] == ["a0", "a1", "a2", "a3", "a4"]
    assert {s for s, _ in by} == {"c"}
    assert neighbours.nearest_vectors(frame(spark, []), "c", "id", "v").count() == 0


def test_hot_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    x = np.random.default_rng(5).standard_normal((400, 64)).astype(np.float32)
    got = neighbours.nearest_vectors(frame(spark, [("c", f"{i:05d}", v.tolist()) for i, v in enumerate(x)]), "c", "id", "v", cells=1).collect()
    _, want = brute(x, 5)
    pairs = {(int(r.id), int(r.neighbour)) for r in got}
    assert len(got) == 2000 and np.mean([(i, j) in pairs for i in range(400) for j in want[i]]) > 0.99


def test_scopes_beside_a_larger_one(spark):
    rng = np.random.default_rng(7)
    scopes = {"big": rng.standard_normal((12_000, 64)), "mid": rng.standard_normal((200, 64)), "few": rng.standard_normal((20, 64)), "six": rng.standard_normal((6, 64)), "two": rng.standard_normal((2, 64))}
    got = neighbours.nearest_vectors(frame(spark, [(c, f"{i:05d}", v.tolist()) for c, x in scopes.items() for i, v in enumerate(x)]), "c", "id", "v").collect()
    for c, x in scopes.items():
        pairs = {(int(r.id), int(r.neighbour)) for r in got if r.scope == c}
        assert len(pairs) == len(x) * min(5, len(x) - 1), c
        if c != "big":
            assert np.mean([(i, j) in pairs for i, near in enumerate(brute(x, min(5, len(x) - 1))[1]) for j in near]) >= 0.99, c


def test_further_cells_where_the_nearest_hold_too_few(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(64)[i] + 0.01 * rng.standard_normal((3 if i < 8 else 200, 64)) for i in range(12)])
    got = neighbours.nearest_vectors(frame(spark, [("c", f"{i:05d}", v.tolist()) for i, v in enumerate(x)]), "c", "id", "v", cells=12, probes=1).collect()
    assert len(got) == 5 * len(x)
    centre, counts = np.eye(4, 64, dtype=np.float32), np.array([2, 0, 1, 9])
    at, cell, home = neighbours.probed(np.array([7]), np.array([[1, 0.5, 0.2, 0.1] + [0] * 60], np.float32), centre, counts, 1, 2)
    assert at.tolist() == [7, 7, 7] and cell.tolist() == [0, 1, 2] and home.tolist() == [True, False, False]


def test_exact_way_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    rows = np.random.default_rng(9).standard_normal((1_000, 16)).astype(np.float32)
    df = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(rows)], "scope string, id int, vec array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.nearest_vectors(df, "scope", "id", "vec", dim=16, k=5, exact=True).collect()}
    u = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    assert got == {(i, int(j)) for i in range(1_000) for j in np.argsort(-c[i])[:5]}
