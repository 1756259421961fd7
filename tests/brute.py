"""Plain reference computations on small fixtures, in numpy and Python only."""

from itertools import combinations

import numpy as np


def entropy(n):
    p = np.asarray(n, float)
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def joint(x, y):
    out = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(out, (x, y), 1)
    return out


def information(states):
    """{(i, j): plug-in information} of the columns of an integer matrix."""
    out = {}
    for i, j in combinations(range(states.shape[1]), 2):
        c = joint(states[:, i], states[:, j])
        out[i, j] = entropy(c.sum(1)) + entropy(c.sum(0)) - entropy(c.ravel())
    return out


def spanning_tree(weights, nodes):
    """Prim, heaviest edge first."""
    nodes = list(nodes)
    seen, out = {nodes[0]}, set()
    while len(seen) < len(nodes):
        best = max((e for e in weights if len(seen & set(e)) == 1), key=lambda e: weights[e])
        out.add(best)
        seen |= set(best)
    return out


def dbscan(d, w, eps, min_mass):
    """State per component: cores by neighbourhood mass, border to the nearest core, the rest noise."""
    k = len(w)
    near = d <= eps
    core = near @ w >= min_mass
    part = [-1] * k
    for start in range(k):
        if core[start] and part[start] < 0:
            todo, part[start] = [start], start
            while todo:
                i = todo.pop()
                for j in range(k):
                    if near[i, j] and core[j] and part[j] < 0:
                        part[j] = start
                        todo.append(j)
    for i in range(k):
        if not core[i]:
            options = [(d[i, j], j) for j in range(k) if core[j] and near[i, j]]
            if options:
                part[i] = part[min(options)[1]]
    mass = {p: sum(w[i] for i in range(k) if part[i] == p) for p in set(part) if p >= 0}
    rank = {p: r for r, p in enumerate(sorted(mass, key=lambda p: (-mass[p], p)))}
    return [rank[p] if p >= 0 else k - 1 for p in part]


def chain_states(n, seed=0, stay=0.8):
    """Columns 0-1-2-3 form a Markov chain, column 4 hangs on 1."""
    rng = np.random.default_rng(seed)
    s = np.zeros((n, 5), int)
    s[:, 0] = rng.integers(0, 3, n)
    for child, parent in ((1, 0), (2, 1), (3, 2), (4, 1)):
        keep = rng.random(n) < stay - 0.05 * child
        s[:, child] = np.where(keep, s[:, parent], rng.integers(0, 3, n))
    return s
