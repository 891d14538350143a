"""Fits per date that take several passes: each pass is one sum over the blocks of all dates that aren't done yet.

Frames of fits have a row for each date: by, coef, intercept.  Work is done on regressors at mean 0 and deviation 1 within
their date, so that plain sums are exact enough, and is put back at the end.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import Block, mix, moments, moments_combined, moments_of, parted, summed, updated
from ..functions.linear import forest_sums, ols
from ..functions.tables import cut_lineage

#: The frame of a date: its rows, means and deviations of regressors, mean of y, and the least-squares fit in that frame.
FRAME = "total double, center array<double>, spread array<double>, level double, slope array<double>, deviation double"


def framed(blocks: DataFrame) -> DataFrame:
    def of(r: dict) -> dict:
        n, mx, my, sxx, sxy, syy = parted(r["sums"])
        spread = np.sqrt(np.diag(sxx))
        spread = np.where(spread > 1e-12 * np.maximum(np.abs(mx), 1e-300), spread, 1.0)
        slope = ols(n, mx, my, sxx, sxy, syy)[0] * spread
        rest = syy - 2 * slope @ (sxy / spread) + slope @ (sxx / np.outer(spread, spread)) @ slope
        return {"total": n, "center": mx, "spread": spread, "level": my, "slope": slope, "deviation": math.sqrt(max(rest, 0.0))}

    return cut_lineage(updated(moments(blocks), of, FRAME))


def inside(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a block in the frame of its date."""
    return (b.x - b.center) / b.spread, b.y - b.level


def outside(r: dict, slope: np.ndarray, shift: float) -> dict:
    coef = slope / r["spread"]
    return {"coef": coef, "intercept": float(r["level"] + shift - r["center"] @ coef)}


FIT = "coef array<double>, intercept double"


# -- Huber --


def huber(blocks: DataFrame, epsilon: float, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """Squares within epsilon scales and lines beyond, with the scale as a parameter.  For a given set of rows beyond, the
    best fit and scale have a closed form, from which the next set follows: a few passes reach sets that stay.  Dates
    that don't settle in ten passes, or have no such form, go on by reweighted least squares."""
    shape = f"{FRAME}, shift double, scale double, turn int, exact boolean, done boolean"

    def begin(r: dict) -> dict:
        k = len(r["slope"])
        flat = r["deviation"] <= 1e-12 * max(abs(r["level"]), 1e-300)
        return {**r, "shift": 0.0, "scale": max(r["deviation"], 1e-12), "turn": 0, "exact": alpha == 0, "done": bool(flat or r["total"] <= k + 1)}

    def part(b: Block) -> np.ndarray:
        x, y = inside(b)
        z = np.column_stack([np.ones(b.n), x, y])
        rest = y - b.shift - x @ b.slope
        near = np.abs(rest) <= epsilon * b.scale
        weight = near.astype(float) if b.exact else np.minimum(1.0, epsilon * b.scale / np.maximum(np.abs(rest), 1e-300))
        return np.concatenate([[near.sum(), (rest[near] ** 2).sum()], ((z * weight[:, None]).T @ z).ravel(), z.T @ (np.sign(rest) * ~near)])

    def step(r: dict) -> dict:
        k, s = len(r["slope"]), r["sums"]
        size = k + 2
        square, signs = s[2 : 2 + size * size].reshape(size, size), s[2 + size * size :]
        left, right, far = square[:-1, :-1], square[:-1, -1], r["total"] - s[0]
        old, scale, exact = np.concatenate([[r["shift"]], r["slope"]]), r["scale"], bool(r["exact"])
        room = r["total"] - epsilon**2 * far
        if exact:
            inverse = np.linalg.pinv(left, hermitian=True)
            plain, pull = inverse @ right, epsilon * inverse @ signs[:-1]
            rest, room = square[-1, -1] - plain @ right, room - pull @ left @ pull
            exact = bool(s[0] > k + 1 and room > 0 and rest > 0)
            if exact:
                scale = math.sqrt(rest / room)
                new = plain + scale * pull
            else:
                new = old
        else:
            new = np.linalg.pinv(left + np.diag(np.concatenate([[0.0], alpha * scale / r["spread"] ** 2])), hermitian=True) @ right
            scale = max(math.sqrt(s[1] / room), 1e-12) if room > 0 and s[0] else scale
        moved = np.abs(new - old).max() + abs(scale - r["scale"])
        done = moved < (1e-10 * max(1.0, np.abs(new).max()) if exact else tol) and exact == r["exact"]
        return {**r, "slope": new[1:], "shift": float(new[0]), "scale": float(scale), "turn": r["turn"] + 1, "exact": exact and r["turn"] < 9, "done": bool(done)}

    state = cut_lineage(updated(framed(blocks), begin, shape))
    for _ in range(max_iter):
        live = state.where(~F.col("done"))
        if live.isEmpty():
            break
        sums = summed(blocks.join(live, "by"), part)
        state = cut_lineage(state.where("done").unionByName(updated(live.join(sums, "by"), step, shape)))
    return updated(state, lambda r: outside(r, r["slope"], r["shift"]), FIT)


# -- subsets drawn by hash --


def lots(keys: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row and trial, which depends on the row's key alone."""
    salt = mix(np.arange(1, trials + 1, dtype=np.uint64) + np.uint64(seed << 32))
    return (mix(keys[:, None] ^ salt) >> np.uint64(11)).astype(float) / 2.0**53


def least_lots(x: np.ndarray, y: np.ndarray, lot: np.ndarray, size: int) -> np.ndarray:
    """trials, size, (lot, y, x...): the rows with the least lots of each trial; missing ones have an infinite lot."""
    out = np.zeros((lot.shape[1], size, x.shape[1] + 2))
    out[:, :, 0] = np.inf
    n = min(size, len(y))
    at = np.argsort(lot, axis=0, kind="stable")[:n].T
    out[:, :n, 0], out[:, :n, 1], out[:, :n, 2:] = np.take_along_axis(lot.T, at, 1), y[at], x[at]
    return out


def fewer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.concatenate([a, b], axis=1)
    return np.take_along_axis(c, np.argsort(c[:, :, 0], axis=1, kind="stable")[:, : a.shape[1], None], 1)


def solved_subsets(sample: np.ndarray) -> np.ndarray:
    """intercept and coefficients of each trial's subset, by least squares."""
    known = np.isfinite(sample[:, :, :1])
    a = np.concatenate([np.ones_like(known, float), sample[:, :, 2:]], axis=2) * known
    return (np.linalg.pinv(a) @ (sample[:, :, 1:2] * known))[:, :, 0]


def consensus(blocks: DataFrame, threshold: float, trials: int, min_samples: float | int | None, seed: int) -> DataFrame:
    """The fit to the rows within `threshold` of the best of `trials` fits to subsets.  A subset of a fixed number of rows
    (None: one more than regressors) are those with the least lots; of a share of rows, those with a lot below it.  The
    fit with most rows within counts, then the one with the least sum of their errors, then the first."""
    share = isinstance(min_samples, float) and min_samples <= 1

    def draw(b: Block) -> np.ndarray:
        x, y = inside(b)
        lot = lots(b.keys, trials, seed)
        if not share:
            return least_lots(x, y, lot, max(min_samples or 0, x.shape[1] + 1)).ravel()
        z = np.column_stack([np.ones(b.n), x, y])
        i, j = np.triu_indices(z.shape[1])
        return ((lot < min_samples).T.astype(float) @ (z[:, i] * z[:, j])).ravel()

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if share:
            return a + b
        size = max(min_samples or 0, 0)
        width = len(a) // trials
        k = next(k for k in range(1, width) if width == max(size, k + 1) * (k + 2))
        return fewer(a.reshape(trials, -1, k + 2), b.reshape(trials, -1, k + 2)).ravel()

    def fit(r: dict) -> dict:
        k = len(r["slope"])
        if not share:
            fits = solved_subsets(r["sums"].reshape(trials, -1, k + 2))
        else:
            i, j = np.triu_indices(k + 2)
            square = np.zeros((trials, k + 2, k + 2))
            square[:, i, j] = square[:, j, i] = r["sums"].reshape(trials, -1)
            fits = (np.linalg.pinv(square[:, :-1, :-1], hermitian=True) @ square[:, :-1, -1:])[:, :, 0]
        return {**r, "fits": fits.ravel()}

    def error(b: Block) -> np.ndarray:
        x, y = inside(b)
        fits = b.fits.reshape(-1, x.shape[1] + 1)
        return np.abs(y[:, None] - fits[:, 0] - x @ fits[:, 1:].T)

    def score(b: Block) -> np.ndarray:
        e = error(b)
        near = e <= threshold
        return np.concatenate([near.sum(0), (e * near).sum(0)])

    def best(r: dict) -> dict:
        count, wrong = r["sums"].reshape(2, -1)
        at = min(range(trials), key=lambda t: (-count[t], wrong[t], t))
        return {**r, "fits": r["fits"].reshape(trials, -1)[at]}

    def refit(b: Block) -> np.ndarray:
        x, y = inside(b)
        return moments_of(np.column_stack([y, x])[error(b)[:, 0] <= threshold])

    def last(r: dict) -> dict:
        n, mx, my, *rest = parted(r["sums"])
        slope, shift = ols(n, mx, my, *rest) if n > len(mx) else (r["slope"], 0.0)
        return outside(r, slope, shift)

    frame, with_fits = framed(blocks), f"{FRAME}, fits array<double>"
    fits = cut_lineage(updated(frame.join(summed(blocks.join(frame, "by"), draw, merge), "by"), fit, with_fits))
    chosen = cut_lineage(updated(fits.join(summed(blocks.join(fits, "by"), score), "by"), best, with_fits))
    return updated(chosen.join(summed(blocks.join(chosen, "by"), refit, moments_combined), "by"), last, FIT)


def theil_sen(blocks: DataFrame, most: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """The spatial median of the exact fits to subsets of as many rows as coefficients: all subsets where there are `most`
    at most, else the rows with the least lots of `most` trials."""

    def few(size: int) -> int:
        n = size
        while math.comb(n + 1, size) <= most:
            n += 1
        return n

    def shapes(k: int) -> tuple[int, int]:
        return few(k + 1) * (k + 2), most * (k + 1) * (k + 2)

    def draw(b: Block) -> np.ndarray:
        x, y = inside(b)
        lot, size = lots(b.keys, most, seed), x.shape[1] + 1
        return np.concatenate([least_lots(x, y, lot[:, :1], few(size)).ravel(), least_lots(x, y, lot, size).ravel()])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = next(k for k in range(1, len(a)) if sum(shapes(k)) == len(a))
        cut = shapes(k)[0]
        return np.concatenate([fewer(u.reshape(t, -1, k + 2), v.reshape(t, -1, k + 2)).ravel() for u, v, t in ((a[:cut], b[:cut], 1), (a[cut:], b[cut:], most))])

    def median(r: dict) -> dict:
        k = len(r["slope"])
        size, cut = k + 1, shapes(k)[0]
        if r["total"] < size:
            return outside(r, r["slope"], 0.0)
        sample = r["sums"][cut:].reshape(most, size, k + 2)
        if math.comb(int(r["total"]), size) <= most:
            every = r["sums"][:cut].reshape(-1, k + 2)[: int(r["total"])]
            sample = every[np.array(list(combinations(range(len(every)), size)))]
        a = np.concatenate([np.ones((len(sample), size, 1)), sample[:, :, 2:]], axis=2)
        good = np.abs(np.linalg.det(a)) > 1e-12
        if not good.any():
            return outside(r, r["slope"], 0.0)
        fits = np.linalg.solve(a[good], sample[good][:, :, 1:2])[:, :, 0]
        fits[:, 1:] /= r["spread"]
        fits[:, 0] += r["level"] - fits[:, 1:] @ r["center"]
        middle = spatial_median(fits, max_iter, tol)
        return {"coef": middle[1:], "intercept": float(middle[0])}

    frame = framed(blocks)
    return updated(frame.join(summed(blocks.join(frame, "by"), draw, merge), "by"), median, FIT)


def spatial_median(points: np.ndarray, max_iter: int = 300, tol: float = 1e-3) -> np.ndarray:
    """The point with the least sum of distances, by Weiszfeld's iteration.  The points' number is bounded."""
    at = points.mean(0)
    for _ in range(max_iter):
        weight = 1 / np.maximum(np.linalg.norm(points - at, axis=1), 1e-12)
        new = weight @ points / weight.sum()
        near = np.linalg.norm(new - at) < tol * max(np.linalg.norm(at), 1e-12)
        at = new
        if near:
            break
    return at


# -- forest --

#: Trees that a task grows over the rows of a date.
TREES = 10


def forest(blocks: DataFrame, k: int, trees: int, *options) -> DataFrame:
    """row (the last column of x) and fit, the mean of the trees.  A task has the rows of a date as columns, in an order
    that doesn't depend on how they were dealt."""

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        names, x, y = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["keys"].to_pylist()]), *(np.concatenate([np.frombuffer(v) for v in rows[c].to_pylist()]) for c in ("x", "y"))
        x, first = x.reshape(-1, k + 1), key[1].as_py() * TREES
        order = np.lexsort((*x[:, :k].T, y, names))
        sums = forest_sums(x[order, :k], y[order], range(first, min(first + TREES, trees)), *options)
        return pa.table({"row": x[order, k].astype(np.int64), "part": sums})

    dealt = blocks.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit((trees - 1) // TREES))))
    return dealt.select("by", "some", "keys", "y", "x").groupBy("by", "some").applyInArrow(grow, "row long, part double").groupBy("row").agg((F.sum("part") / trees).alias("fit"))


# -- independent components --


def components(blocks: DataFrame, count: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """by, center and turn (a matrix by rows): sources are (x - center) @ turn, of unit variance.  The fixed point of the
    log-cosh contrast, all sources at once; its expectations are sums over blocks."""
    shape = "total double, center array<double>, white array<double>, w array<double>, done boolean"

    def begin(r: dict) -> dict:
        n, mx, _, sxx, *_ = parted(r["sums"])
        values, vectors = np.linalg.eigh(sxx)
        keep = np.argsort(values)[::-1][:count]
        keep = keep[values[keep] > 1e-24 * max(values.max(initial=0.0), 1e-300)]
        k = len(keep)
        w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0] if k else np.zeros((0, 0))
        return {"total": n, "center": mx, "white": (vectors[:, keep] / np.sqrt(values[keep])).ravel(), "w": w.ravel(), "done": k == 0}

    def matrices(b) -> tuple[np.ndarray, np.ndarray]:
        get = b.get if isinstance(b, dict) else lambda name: getattr(b, name)
        white = get("white").reshape(len(get("center")), -1)
        return white, get("w").reshape(white.shape[1], -1)

    def part(b: Block) -> np.ndarray:
        white, w = matrices(b)
        s = (b.x - b.center) @ white
        g = np.tanh(s @ w.T)
        return np.concatenate([(g.T @ s).ravel(), (1 - g**2).sum(0)])

    def step(r: dict) -> dict:
        _, w = matrices(r)
        k = len(w)
        new = (r["sums"][: k * k].reshape(k, k) - r["sums"][k * k :, None] * w) / r["total"]
        a, _, c = np.linalg.svd(new, full_matrices=False)
        new = a @ c
        return {**r, "w": new.ravel(), "done": bool(np.abs(np.abs((new * w).sum(1)) - 1).max() < tol)}

    state = cut_lineage(updated(moments(blocks), begin, shape))
    for _ in range(max_iter):
        live = state.where(~F.col("done"))
        if live.isEmpty():
            break
        sums = summed(blocks.join(live, "by"), part)
        state = cut_lineage(state.where("done").unionByName(updated(live.join(sums, "by"), step, shape)))
    return updated(state, lambda r: {"center": r["center"], "turn": (matrices(r)[0] @ matrices(r)[1].T).ravel()}, "center array<double>, turn array<double>")
