"""Small numpy estimators for one cross-section, and solvers that need only its centred moments."""

from __future__ import annotations

import math

import numpy as np

from .blocks import mix

#: Rows of trees that grow together, so that small cross-sections don't wait on single calls.
TOGETHER = 60_000


# -- from moments: n, means and centred second moments (covariances with denominator n) --


def ols(n, mx, my, sxx, sxy, syy):
    spread = np.diag(sxx)
    known = (spread > 1e-300) & (spread > 1e-24 * mx**2)  # else constant, but for rounding
    scale = np.where(known, np.sqrt(np.where(known, spread, 1.0)), np.inf)  # columns of very different size stay solvable
    coef = np.linalg.pinv(sxx / np.outer(scale, scale), hermitian=True, rcond=1e-12) @ (sxy / scale) / scale
    return coef, my - mx @ coef


def ridge(n, mx, my, sxx, sxy, syy, alpha=1.0):
    coef = np.linalg.solve(n * sxx + alpha * np.eye(len(sxy)), n * sxy) if alpha else ols(n, mx, my, sxx, sxy, syy)[0]
    return coef, my - mx @ coef


def elastic_net(n, mx, my, sxx, sxy, syy, alpha=1.0, l1_ratio=0.5, max_iter=1000, tol=1e-4):
    """Coordinate descent for (1/2n)|y - Xw|^2 + alpha (l1_ratio |w|_1 + (1 - l1_ratio)/2 |w|^2)."""
    w, l1, l2 = np.zeros(len(sxy)), alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(w)):
            if sxx[j, j] + l2 <= 0:
                continue
            rho = sxy[j] - sxx[j] @ w + sxx[j, j] * w[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (sxx[j, j] + l2)
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest <= tol * max(np.abs(w).max(initial=0.0), 1e-300):
            break
    return w, my - mx @ w


def lasso(n, mx, my, sxx, sxy, syy, alpha=0.01, max_iter=1000, tol=1e-4):
    return elastic_net(n, mx, my, sxx, sxy, syy, alpha, 1.0, max_iter, tol)


def principal_components(n, mx, my, sxx, sxy, syy, n_components=10):
    """Regression on the leading scores without intercept: the mean of y stays in the residual."""
    values, vectors = np.linalg.eigh(sxx)
    keep = np.argsort(values)[::-1][: int(min(n_components, len(sxy), n))]
    keep = keep[values[keep] > 1e-12 * max(values.max(initial=0.0), 1e-300)]
    coef = vectors[:, keep] @ ((vectors[:, keep].T @ sxy) / values[keep])
    return coef, -mx @ coef


def components_with_intercept(n, mx, my, sxx, sxy, syy, n_components=10):
    """Regression on the leading scores and an intercept."""
    coef, _ = principal_components(n, mx, my, sxx, sxy, syy, n_components)
    return coef, my - mx @ coef


def through_origin(n, mx, my, sxx, sxy, syy):
    coef = np.linalg.pinv(sxx + np.outer(mx, mx), hermitian=True, rcond=1e-12) @ (sxy + mx * my)
    return coef, 0.0


def bayesian_ridge(n, mx, my, sxx, sxy, syy, max_iter=300, tol=1e-3, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    """Evidence maximisation for the noise precision and the weight precision, on the eigenvalues of the Gram matrix."""
    values, vectors = np.linalg.eigh(n * sxx)
    values, target = np.maximum(values, 0), vectors.T @ (n * sxy)
    alpha, lam, coef = 1 / max(syy, 1e-12), 1.0, np.zeros(len(sxy))
    for _ in range(max_iter):
        before = coef
        rotated = target / (values + lam / alpha)
        coef = vectors @ rotated
        rss = max(n * syy - 2 * coef @ (n * sxy) + coef @ (n * sxx) @ coef, 0.0)
        gamma = np.sum(alpha * values / (lam + alpha * values))
        lam = (gamma + 2 * l1) / (coef @ coef + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rss + 2 * a2)
        if np.abs(coef - before).sum() < tol:
            break
    return coef, my - mx @ coef


# -- from rows --


def kernel_of(a, b, kernel="rbf", gamma=1.0, degree=3, coef0=1.0):
    """The kernel of all rows of a with all rows of b."""
    product = a @ b.T
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * product, 0))
    return product if kernel == "linear" else (gamma * product + coef0) ** degree


def kernel_ridge_fit(x, y, alpha=1.0, kernel="rbf", gamma=None, degree=3, coef0=1.0):
    """Of one small cross-section, by its kernel matrix; `operators/kernels.py` makes none."""
    k = kernel_of(x, x, kernel, 1 / x.shape[1] if gamma is None else gamma, degree, coef0)
    return k @ np.linalg.solve(k + alpha * np.eye(len(y)), y)


def grown(x, y, weight, order, root, depth, min_leaf=1, max_features=None, key=None):
    """Values that regression trees on squared error give their rows, as many trees as roots: all nodes of a level are
    split at once.  root: each row's tree, from 0 on; weight: how often a row counts, 0 if only its value is asked for;
    order: by column, rows by root and then by that column.  Of columns in an order drawn from the keys of the roots, a
    node tries `max_features` and more while none splits it; without a limit it tries all."""
    k, out, node = x.shape[1], np.empty(len(y)), root.copy()
    order, rows = [o[weight[o] > 0] for o in order], np.arange(len(y))
    while len(rows):
        o = order[0]
        sizes = np.bincount(node[o])
        m, first = len(sizes), np.cumsum(sizes) - sizes
        own, held = np.repeat(np.arange(m), sizes), y[o]
        total = np.add.reduceat(weight[o], first)
        mean = np.add.reduceat(weight[o] * held, first) / total
        live = (depth > 0) & (total >= 2 * min_leaf) & (np.maximum.reduceat(held, first) > np.minimum.reduceat(held, first))
        gain, column, cut = np.full(m, -np.inf), np.full(m, -1), np.zeros(m)
        turns = np.tile(np.arange(k), (m, 1)) if max_features is None else np.argsort(mix(key[:, None] ^ mix(np.arange(1, k + 1, dtype=np.uint64))), axis=1)
        for turn in range(k):
            asked = live if max_features is None or turn < max_features else live & (column < 0)
            for j in range(k):
                at = np.flatnonzero((asked & (turns[:, turn] == j))[own])
                if len(at):
                    nodes, found, middle = best_cuts(x[:, j], y, weight, order[j][at], own[at], total, mean, min_leaf)
                    better = found > gain[nodes] + 1e-15
                    nodes = nodes[better]
                    gain[nodes], column[nodes], cut[nodes] = found[better], j, middle[better]
        split = column >= 0
        at = node[rows]
        out[rows[~split[at]]] = mean[at[~split[at]]]
        rows, at = rows[split[at]], at[split[at]]
        node[rows] = 2 * (np.cumsum(split) - 1)[at] + (x[rows, column[at]] > cut[at])
        key, depth, kept = None if key is None else mix(np.repeat(key[split], 2) + np.tile(np.array([1, 2], np.uint64), split.sum())), depth - 1, split[own]
        if depth == 0:
            o = order[0][kept]
            out[rows] = (np.bincount(node[o], weight[o] * y[o]) / np.bincount(node[o], weight[o]))[node[rows]]
            break
        order = [parted_by(o[kept], node) for o in order]
    return out


def best_cuts(v, y, weight, o, own, total, mean, min_leaf):
    """Nodes that a column can split, what that takes off their squared errors, and where: the first of the best cuts.
    o: rows by node and value; own: their nodes."""
    v, w = v[o], weight[o]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    first, segment = np.flatnonzero(new), np.cumsum(new) - 1
    n, s = np.cumsum(w), np.cumsum(w * (y[o] - mean[own]))
    n, s = (c - np.concatenate([[0], c[first[1:] - 1]])[segment] for c in (n, s))
    rest = total[own] - n
    good = (n >= min_leaf) & (rest >= min_leaf)
    good[:-1] &= ~new[1:] & (v[1:] > v[:-1])
    good[-1] = False
    gain = np.where(good, s * s * (1 / n + 1 / np.maximum(rest, 1)), -np.inf)
    hit = np.flatnonzero(good & (gain == np.maximum.reduceat(gain, first)[segment]))
    hit = hit[np.unique(segment[hit], return_index=True)[1]]
    middle = (v[hit] + v[hit + 1]) / 2
    return own[hit], gain[hit], np.where(middle < v[hit + 1], middle, v[hit])


def parted_by(o, node):
    """Rows by their new nodes, of which two follow from each old one; order within a node stays."""
    at = node[o]
    right = (at & 1).astype(bool)
    sizes = np.bincount(at)
    out, side = np.empty_like(o), np.repeat(np.tile([False, True], len(sizes) // 2), sizes)
    out[~side], out[side] = o[~right], o[right]
    return out


def forest_sums(x, y, trees, max_features=1, max_depth=None, min_leaf=1, bootstrap=True, seed=0):
    """The sum of what the trees of some numbers give each row.  What a tree draws depends on its number alone."""
    n, k = x.shape
    order, total, many = [np.argsort(x[:, j], kind="stable") for j in range(k)], np.zeros(n), max(1, TOGETHER // n)
    for some in (trees[i : i + many] for i in range(0, len(trees), many)):
        weight = [np.bincount(np.random.default_rng((seed, t)).integers(0, n, n), minlength=n) if bootstrap else np.ones(n, np.int64) for t in some]
        shift = np.arange(len(some)) * n
        key = mix(np.array(some, np.uint64) + np.uint64(1) + mix(np.array([seed + 1], np.uint64)))
        total += grown(np.tile(x, (len(some), 1)), np.tile(y, len(some)), np.concatenate(weight), [(o + shift[:, None]).ravel() for o in order], np.repeat(np.arange(len(some)), n), max_depth or 64, min_leaf, max_features, key).reshape(len(some), n).sum(0)
    return total


def forest_fit(x, y, n_estimators=50, max_features=1, max_depth=None, min_leaf=1, bootstrap=True, seed=0):
    return forest_sums(x, y, range(n_estimators), max_features, max_depth, min_leaf, bootstrap, seed) / n_estimators


def boosting_fit(x, y, n_estimators=50, learning_rate=0.1, max_depth=3, subsample=1.0, seed=0):
    draw, fit, root = np.random.default_rng(seed), np.full(len(y), y.mean()), np.zeros(len(y), np.int64)
    order = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
    for _ in range(n_estimators):
        weight = np.ones(len(y), np.int64)
        if subsample < 1:
            weight[draw.permutation(len(y))[max(1, int(subsample * len(y))) :]] = 0
        fit += learning_rate * grown(x, y - fit, weight, order, root, max_depth)
    return fit
