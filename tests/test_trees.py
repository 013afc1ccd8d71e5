"""Tree operators against brute force and closed forms."""

from itertools import product

import numpy as np
import pytest

from clonal_spark.operators import phylo as ph
from clonal_spark.operators import phylo_np as pn
from clonal_spark.sources.observations import from_arrays  # noqa: F401  (same session)


def centers_df(spark, c):
    return spark.createDataFrame([(0, k, f"s{s}", float(c[k, s])) for k in range(c.shape[0]) for s in range(c.shape[1])], "tumour_id long, k int, sample_id string, center double")


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_cayley(k):
    trees = {tuple(t.tolist()) for t in pn.enumerate_trees(k)}
    assert len(trees) == k ** (k - 2) and all(t[0] == -1 and t.count(-1) == 1 for t in trees)


def test_order_and_cycles():
    assert pn.topological_order([(0, 1), (1, 2)], 3) == [0, 1, 2] and pn.topological_order([(0, 2), (0, 1)], 3) == [0, 1, 2]
    assert not pn.is_valid_dag([(0, 1), (1, 0)], 2)
    assert pn.parents_of([(2, 0), (0, 1)], 3).tolist() == [2, 0, -1]
    with pytest.raises(ValueError):
        pn.parents_of([(0, 1), (1, 0)], 2)


def test_column_forms_equal_numpy(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        c = np.round(rng.random((5, 3)), 3)
        df = centers_df(spark, c)
        assert {r.k: r.parent for r in ph.greedy_tree(df).collect()} == dict(enumerate(pn.greedy_parents(c).tolist()))
        assert [r.k for r in ph.nesting_order(df).orderBy("place").collect()] == pn.nesting_order(c).tolist()
        clamped = pn.clamp_chain(c)
        assert {(r.k, r.sample_id): r.center for r in ph.clamp_chain(df).collect()} == pytest.approx({(k, f"s{s}"): clamped[k, s] for k in range(5) for s in range(3)})
        want = pn.pairs_tensor(c)
        for r in ph.pairs_tensor(df).collect():
            assert (r.ancestor, r.descendant, r.branching, r.same) == pytest.approx(want[r.k, r.other].tolist())


def test_clamp_equals_the_loop():
    rng = np.random.default_rng(4)
    for _ in range(50):
        c = rng.random((6, 2))
        order, out = pn.nesting_order(c), c.copy()
        for a, b in zip(order, order[1:]):
            out[b] = np.minimum(out[b], out[a] - pn.TOL)
        assert pn.clamp_chain(c) == pytest.approx(np.clip(out, 1e-6, 1 - 1e-6), abs=1e-12)


def test_pairwise_is_the_best_of_all_trees():
    c = np.array([[0.9, 0.8], [0.5, 0.3], [0.3, 0.4], [0.1, 0.05]])
    pairs = pn.pairs_tensor(c)
    assert pairs.sum(2) == pytest.approx(np.ones((4, 4)))
    best = max(pn.tree_score(t, pairs) for t in pn.enumerate_trees(4))
    assert pn.tree_score(pn.pairwise_parents(c), pairs) == best
    assert (pn.pairwise_parents(np.linspace(0.9, 0.1, 9)[:, None]) == -1).sum() == 1


def test_longitudinal_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        c = np.sort(rng.random((4, 3)), 0)[::-1] * np.array([[1.0], [0.6], [0.4], [0.2]])
        flat = c.std(1) < 1e-10
        weight = lambda p, j: 0.5 if flat[p] or flat[j] else np.corrcoef(c[p], c[j])[0, 1]
        root, best = int(pn.nesting_order(c)[0]), -np.inf
        for parents in product(range(4), repeat=4):
            ok = all(p != j for j, p in enumerate(parents) if j != root)
            kids = {p: [j for j in range(4) if j != root and parents[j] == p] for p in range(4)}
            ok = ok and all((c[k].sum(0) <= c[p] + 1e-6).all() for p, k in kids.items() if k)
            ok = ok and pn.is_valid_dag([(parents[j], j) for j in range(4) if j != root], 4)
            if ok:
                best = max(best, sum(weight(parents[j], j) for j in range(4) if j != root))
        got = pn.longitudinal_parents(c)
        if np.isfinite(best):
            assert sum(weight(got[j], j) for j in range(4) if j != root) == pytest.approx(best, abs=1e-6)
    assert (pn.longitudinal_parents(np.array([[0.8, 0.2], [0.2, 0.8]])) == -1).sum() == 1  # nothing is feasible


def test_depths(spark):
    tree = spark.createDataFrame([(0, 0, -1), (0, 1, 0), (0, 2, 1), (0, 3, 0)], "tumour_id long, k int, parent int")
    assert {r.k: r.depth for r in ph.depths(tree).collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    assert {r.k: (r.x, r.y) for r in ph.layout(tree).collect()}[3] == (0.75, -1.0)
