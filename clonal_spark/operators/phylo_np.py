"""Clone trees over K centers (K is small: drivers and group functions hold them as arrays)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import product

import numpy as np

from clonal_spark.functions.mathx import np_sigmoid

TOL, LEAST = 1e-6, 1e-6
#: Relations of a pair.
ANCESTOR, DESCENDANT, BRANCHING, SAME = range(4)
TEMPERATURE, BRANCH_SCORE, SAME_SHIFT = 0.1, 1e-3, 5.0
ENUMERATED, SAMPLED = 7, 10_000


def nesting_order(centers: np.ndarray) -> np.ndarray:
    """By falling mean; equal means by index."""
    return np.argsort(-centers.mean(1), kind="stable")


def nested_in(centers: np.ndarray, tol: float = TOL) -> np.ndarray:
    """[j, k]: j fits below k in every sample."""
    fits = (centers[:, None, :] <= centers[None, :, :] + tol).all(2)
    np.fill_diagonal(fits, False)
    return fits


def greedy_parents(centers: np.ndarray) -> np.ndarray:
    """The tightest clone that holds each clone: least mean above its own; the top clone is the root and takes the rest."""
    k = len(centers)
    means, fits = centers.mean(1), nested_in(centers)
    root = int(nesting_order(centers)[0]) if k else -1
    parents = np.full(k, root)
    for j in range(k):
        options = np.flatnonzero(fits[j] & (means > means[j]))
        if len(options):
            parents[j] = options[np.argmin(means[options])]
    if k:
        parents[root] = -1
    return parents


def clamp_chain(centers: np.ndarray) -> np.ndarray:
    """Each clone at least TOL below the one before it in the nesting order, in every sample (a running minimum)."""
    order = nesting_order(centers)
    rank = np.arange(len(order))[:, None] * TOL
    out = np.empty_like(centers)
    out[order] = np.minimum.accumulate(centers[order] + rank, 0) - rank
    return np.clip(out, LEAST, 1 - LEAST)


def children_of(parents: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for child, parent in enumerate(parents.tolist()):
        if parent >= 0:
            out.setdefault(parent, []).append(child)
    return out


def topological_order(edges: list[tuple[int, int]], k: int) -> list[int]:
    """Parents first; of free nodes those found first. Raises ValueError on a cycle."""
    incoming = [0] * k
    for _, c in edges:
        incoming[c] += 1
    queue = [i for i in range(k) if not incoming[i]]
    for node in queue:
        for c in sorted(c for p, c in edges if p == node):
            incoming[c] -= 1
            if not incoming[c]:
                queue.append(c)
    if len(queue) < k:
        raise ValueError("the edges have a cycle")
    return queue


def is_valid_dag(edges: list[tuple[int, int]], k: int) -> bool:
    try:
        topological_order(edges, k)
    except ValueError:
        return False
    return True


def parents_of(edges: list[tuple[int, int]], k: int) -> np.ndarray:
    """Parents of what the first node without incoming edges reaches; -1 for the rest."""
    roots = sorted(set(range(k)) - {c for _, c in edges})
    if not roots:
        raise ValueError("no root")
    out, queue = np.full(k, -1), [roots[0]]
    for node in queue:
        for c in sorted(c for p, c in edges if p == node):
            if out[c] < 0 and c != roots[0]:
                out[c] = node
                queue.append(c)
    return out


def pairs_tensor(centers: np.ndarray) -> np.ndarray:
    """(K, K, 4) relation probabilities."""
    diff = centers[:, None, :] - centers[None, :, :]
    raw = np.stack(
        [np_sigmoid(diff / TEMPERATURE).mean(2), np_sigmoid(-diff / TEMPERATURE).mean(2), np.full(diff.shape[:2], BRANCH_SCORE), np_sigmoid(SAME_SHIFT - np.abs(diff) / TEMPERATURE).mean(2)], 2
    )
    raw = np.maximum(raw, 1e-10)
    out = raw / raw.sum(2, keepdims=True)
    k = np.arange(len(centers))
    out[k, k] = (0, 0, 0, 1)
    return out


def decode_prufer(sequence: tuple[int, ...], k: int) -> np.ndarray:
    """Parents of the labelled tree of a Prüfer sequence, rooted at node 0: each sequence entry takes the least leaf."""
    degree = [1 + sequence.count(i) for i in range(k)]
    links: list[list[int]] = [[] for _ in range(k)]
    for s in sequence:
        leaf = next(i for i in range(k) if degree[i] == 1)
        links[leaf].append(s)
        links[s].append(leaf)
        degree[leaf] -= 1
        degree[s] -= 1
    last = [i for i in range(k) if degree[i] == 1]
    links[last[0]].append(last[1])
    links[last[1]].append(last[0])
    parents, queue = np.full(k, -1), [0]
    for node in queue:
        for c in links[node]:
            if c != parents[node]:
                parents[c] = node
                queue.append(c)
    return parents


def sequence_of(number: int, k: int) -> tuple[int, ...]:
    """The number-th Prüfer sequence in lexicographic order."""
    digits = []
    for _ in range(k - 2):
        number, d = divmod(number, k)
        digits.append(d)
    return tuple(reversed(digits))


def enumerate_trees(k: int, seed: int | None = None) -> Iterator[np.ndarray]:
    """Parents of all labelled trees on k nodes for k up to 7, of a sample of distinct ones beyond."""
    if k == 1:
        yield np.array([-1])
    elif k == 2:
        yield np.array([-1, 0])
    elif k <= ENUMERATED:
        for s in product(range(k), repeat=k - 2):
            yield decode_prufer(s, k)
    else:
        warnings.warn(f"{k} nodes: {SAMPLED} of {k ** (k - 2)} trees are sampled", stacklevel=2)
        rng = np.random.default_rng(seed)
        for s in dict.fromkeys(map(tuple, rng.integers(0, k, (SAMPLED, k - 2)).tolist())):
            yield decode_prufer(s, k)


def tree_score(parents: np.ndarray, pairs: np.ndarray) -> float:
    """Log-probability of the relations that a tree has."""
    k = len(parents)
    above = np.zeros((k, k), bool)  # [i, j]: i is an ancestor of j
    for j in range(k):
        i = parents[j]
        while i >= 0:
            above[i, j] = True
            i = parents[i]
    relation = np.where(above, ANCESTOR, np.where(above.T, DESCENDANT, BRANCHING))
    logs = np.log(np.maximum(pairs[np.arange(k)[:, None], np.arange(k)[None, :], relation], 1e-30))
    return float(logs.sum() - np.trace(logs))


def pairwise_parents(centers: np.ndarray) -> np.ndarray:
    """The best tree by pair relations: over all trees for K up to 7 (the first of equals), else greedily."""
    k = len(centers)
    if k <= 1:
        return np.full(k, -1)
    pairs = pairs_tensor(centers)
    if k <= ENUMERATED:
        best, top = None, -np.inf
        for parents in enumerate_trees(k):
            if (score := tree_score(parents, pairs)) > top:
                best, top = parents, score
        return best
    order = nesting_order(centers).tolist()
    parents = np.full(k, -1)
    for n, child in enumerate(order[1:], 1):
        there = sorted(order[:n])
        parents[child] = there[int(np.argmax(pairs[there, child, ANCESTOR]))]
    return parents


def longitudinal_parents(centers: np.ndarray) -> np.ndarray:
    """One parent each, root of the top mean, children's sum at most the parent in every sample, with the largest
    sum of parent-child correlations. Exact branch and bound over clones in nesting order: a parent's mean is never
    below its child's, so every assignment is acyclic. Falls back to the greedy tree if nothing is feasible."""
    k = len(centers)
    if k <= 1:
        return np.full(k, -1)
    flat = centers.std(1) < 1e-10
    z = np.where(flat[:, None], 0, (centers - centers.mean(1, keepdims=True)) / np.where(flat, 1, centers.std(1))[:, None])
    weight = z @ z.T / centers.shape[1]
    weight[flat[:, None] | flat[None, :]] = 0.5
    order = nesting_order(centers).tolist()
    fits = nested_in(centers)
    options = {c: [p for p in order[:n] if fits[c, p]] for n, c in enumerate(order) if n}
    bound = [0.0] * (k + 1)
    for n in range(k - 1, 0, -1):
        bound[n] = bound[n + 1] + max((weight[p, order[n]] for p in options[order[n]]), default=-np.inf)
    best: list = [-np.inf, None]
    parents, room = np.full(k, -1), centers + TOL

    def place(n: int, total: float) -> None:
        if total + bound[n] <= best[0] + 1e-12:
            return
        if n == k:
            best[:] = [total, parents.copy()]
            return
        c = order[n]
        for p in sorted(options[c], key=lambda p: (-weight[p, c], p)):
            if (centers[c] <= room[p]).all():
                room[p] -= centers[c]
                parents[c] = p
                place(n + 1, total + weight[p, c])
                parents[c] = -1
                room[p] += centers[c]

    place(1, 0.0)
    return greedy_parents(centers) if best[1] is None else best[1]
