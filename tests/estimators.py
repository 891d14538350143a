"""Estimators over the rows of one cross-section, as plain as can be: what the distributed ones are held against."""

import math

import numpy as np


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return beta[1:], beta[0]


def ransac(x, y, residual_threshold=2.5, max_trials=100, min_samples=None, seed=0):
    """The fit to the largest set of rows within the threshold of a line through a random subset."""
    n, k = x.shape
    size = min(n, max(k + 1, math.ceil(min_samples * n) if min_samples else k + 1))
    draw, best = np.random.default_rng(seed), None
    for _ in range(max_trials):
        rows = draw.choice(n, size, replace=False)
        coef, intercept = least_squares(x[rows], y[rows])
        error = np.abs(y - intercept - x @ coef)
        inside = error <= residual_threshold
        score = (inside.sum(), -error[inside].sum())
        if best is None or score > best[0]:
            best = (score, inside)
        if inside.all():
            break
    inside = best[1] if best[1].sum() > k else np.ones(n, bool)
    return *least_squares(x[inside], y[inside]), inside


def huber_regression(x, y, epsilon=1.35, alpha=0.0, max_iter=100, tol=1e-5):
    """Reweighted least squares with the scale estimated jointly: sum of squares within epsilon scales, linear beyond."""
    coef, intercept = least_squares(x, y)
    scale = max(np.std(y - intercept - x @ coef), 1e-12)
    for _ in range(max_iter):
        r = y - intercept - x @ coef
        # the scale that makes the joint objective stationary: n = sum of squared small residuals / scale^2
        for _ in range(20):
            small = np.abs(r) <= epsilon * scale
            room = len(y) - epsilon**2 * (~small).sum()
            new = math.sqrt(np.sum(r[small] ** 2) / room) if room > 0 and small.any() else scale
            done = abs(new - scale) <= tol * scale
            scale = max(new, 1e-12)
            if done:
                break
        w = np.minimum(1.0, epsilon * scale / np.maximum(np.abs(r), 1e-300))
        a = np.column_stack([np.ones(len(x)), x])
        left = a.T @ (a * w[:, None]) + np.diag([0.0] + [alpha * scale] * x.shape[1])
        beta = np.linalg.pinv(left, hermitian=True) @ (a.T @ (w * y))
        moved = np.abs(beta[1:] - coef).max(initial=0.0) + abs(beta[0] - intercept)
        coef, intercept = beta[1:], beta[0]
        if moved < tol:
            break
    return coef, intercept


def theil_sen(x, y, max_subpopulation=1000, max_iter=300, tol=1e-3, seed=0):
    """Spatial median of the exact fits to subsets of as many rows as there are coefficients."""
    n, k = x.shape
    size = k + 1
    if n < size:
        return least_squares(x, y)
    draw = np.random.default_rng(seed)
    if math.comb(n, size) <= max_subpopulation:
        from itertools import combinations

        subsets = np.array(list(combinations(range(n), size)))
    else:
        subsets = np.array([draw.choice(n, size, replace=False) for _ in range(max_subpopulation)])
    a = np.concatenate([np.ones((len(subsets), size, 1)), x[subsets]], axis=2)
    good = np.abs(np.linalg.det(a)) > 1e-12
    if not good.any():
        return least_squares(x, y)
    fits = np.linalg.solve(a[good], y[subsets[good]][..., None])[..., 0]
    median = fits.mean(0)
    for _ in range(max_iter):
        far = np.linalg.norm(fits - median, axis=1)
        w = 1 / np.maximum(far, 1e-12)
        new = (w[:, None] * fits).sum(0) / w.sum()
        if np.linalg.norm(new - median) < tol * max(np.linalg.norm(median), 1e-12):
            median = new
            break
        median = new
    return median[1:], median[0]


def fast_ica(x, n_components, max_iter=200, tol=1e-4, seed=0):
    """Sources by symmetric fixed-point iteration with the log-cosh contrast; unit variance."""
    centred = x - x.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    k = min(n_components, int((s > 1e-12 * max(s.max(initial=0.0), 1e-300)).sum()))
    white = u[:, :k] * math.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0] if k else np.zeros((0, 0))
    for _ in range(max_iter):
        g = np.tanh(white @ w.T)
        new = g.T @ white / len(x) - (1 - g**2).mean(0)[:, None] * w
        a, _, b = np.linalg.svd(new, full_matrices=False)
        new = a @ b
        done = k == 0 or np.abs(np.abs(np.sum(new * w, axis=1)) - 1).max() < tol
        w = new
        if done:
            break
    return white @ w.T
