import numpy as np
import pytest

from lodeline.llm import neighbours as n


@pytest.mark.parametrize("pairwise", [0, 64, 10**9])
@pytest.mark.parametrize("dim", [16, 64, 130])
def test_search_block_like_brute_force(monkeypatch, pairwise, dim):
    """p3_found: the same neighbours whether the vectors within the bound are compared one by one or as a product; queries in the block and others."""
    monkeypatch.setattr(n, "PAIRWISE", pairwise)
    monkeypatch.setattr(n, "EPSILON", 9)
    draw = np.random.default_rng(2)
    data = n.unit(draw.standard_normal((700, dim)) + 1)
    query = np.concatenate([data[:300], n.unit(draw.standard_normal((40, dim)) + 1)])
    same = np.concatenate([np.arange(300), np.full(40, -1)])
    for k in (5, 699, 900):
        index, value = n.search_block(data, query, same, data.mean(axis=0).astype(np.float32), n.rotation(dim), k)
        want = query @ data.T
        want[np.arange(300), np.arange(300)] = -2
        want = -np.sort(-want, axis=1)[:, : min(k, 700)]
        assert np.allclose(value[:, : want.shape[1]], want, atol=1e-6) and ((index >= 0) == (value > -2)).all() and not (index[:300] == np.arange(300)[:, None]).any()


def test_many_vectors_within_the_bound_are_one_product(monkeypatch):
    """p3_found: where the bound leaves most of a block to be compared, they are not gathered pair by pair."""
    draw, pairs, plain = np.random.default_rng(2), [0], np.einsum

    def counted(how, a, *more):
        pairs[0] += len(a) if how == "ij,ij->i" else 0
        return plain(how, a, *more)

    data = n.unit(draw.standard_normal((1_000, 64)))
    monkeypatch.setattr(np, "einsum", counted)
    n.search_block(data, data, np.arange(1_000), np.zeros(64, np.float32), n.rotation(64), 5)
    assert pairs[0] < 10_000  # of 1 000 000
