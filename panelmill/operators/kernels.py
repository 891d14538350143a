"""Kernel ridge per date in passes over blocks, without a kernel matrix.

A kernel that is a product of few features (linear, polynomial; Gaussian of few regressors, whose numerical rank doesn't
grow with rows) is written as F S F', with a row of features for each row: one pass sums F'F and F'y, a worker solves a
system of their number for each date, and one pass gives the fits.  So work and memory follow the rows.  A Gaussian that
needs more features is solved by conjugate gradients: each step multiplies tiles of two blocks, which takes time by the
square of the rows, but memory of a tile.  Blocks have the row's number as the last column of x.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import Block, summed, updated
from ..functions.linear import kernel_of
from ..functions.tables import cut_lineage

#: Features of a date up to which a Gaussian is written out, nodes of a regressor, and what a kernel's entries may miss.
FEATURES, NODES, EXACT = 1200, 96, 1e-14
#: Steps of conjugate gradients, and the residual, as a share of the target, at which they end.
STEPS, NEAR = 2000, 1e-11
ROW = "row long, fit double"


def lagrange(x: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """Values of the interpolating polynomials of Chebyshev nodes between low and high, a column for each node."""
    angle = (2 * np.arange(count) + 1) * np.pi / (2 * count)
    nodes, weight = np.cos(angle), (-1.0) ** np.arange(count) * np.sin(angle)
    d = (2 * (x - low) / (high - low) - 1)[:, None] - nodes
    hit = d == 0
    terms = weight / np.where(hit, 1.0, d)
    return np.where(hit.any(1)[:, None], hit, terms / terms.sum(1)[:, None])


def gaussian_factor(low: float, high: float, gamma: float) -> tuple[np.ndarray | None, np.ndarray]:
    """A matrix (nodes times features) that takes interpolating polynomials to features whose products are the Gaussian
    between low and high, and the features' weights, descending; None where NODES don't do."""
    if high <= low:
        return np.ones((1, 1)), np.ones(1)
    test = np.linspace(low, high, 301)
    want = np.exp(-gamma * (test[:, None] - test) ** 2)
    for count in range(8, NODES + 1, 4):
        at = low + (high - low) * (np.cos((2 * np.arange(count) + 1) * np.pi / (2 * count)) + 1) / 2
        values, vectors = np.linalg.eigh(np.exp(-gamma * (at[:, None] - at) ** 2))
        keep = np.flatnonzero(values > EXACT / 100 * values.max())[::-1]
        factor = vectors[:, keep] * np.sqrt(values[keep])
        made = lagrange(test, low, high, count) @ factor
        if np.abs(made @ made.T - want).max() < EXACT * 10:
            return factor, values[keep]
    return None, np.zeros(0)


def gaussian_features(low: np.ndarray, high: np.ndarray, gamma: float, most: int) -> dict | None:
    """What `gaussian_of` needs: by regressor nodes, features and the factor; and which products of features count."""
    factors, terms, weight = [], np.zeros((1, 0), int), np.ones(1)
    for a, b in zip(low, high):
        factor, values = gaussian_factor(a, b, gamma)
        if factor is None:
            return None
        factors.append(factor)
        terms = np.column_stack([np.repeat(terms, len(values), axis=0), np.tile(np.arange(len(values)), len(terms))])
        weight = np.outer(weight, values / values[0]).ravel()
        terms, weight = terms[weight > EXACT / 10], weight[weight > EXACT / 10]
        if len(terms) > most:
            return None
    return {"low": low, "high": high, "shape": np.array([f.shape for f in factors], float).ravel(), "factor": np.concatenate([f.ravel() for f in factors]), "terms": terms.astype(float).ravel()}


def gaussian_of(x: np.ndarray, r) -> np.ndarray:
    shape, at = r["shape"].astype(int).reshape(-1, 2), 0
    terms, out = r["terms"].astype(int).reshape(-1, len(shape)), 1.0
    for j, (count, wide) in enumerate(shape):
        factor = r["factor"][at : at + count * wide].reshape(count, wide)
        at += count * wide
        own = lagrange(x[:, j], r["low"][j], r["high"][j], count) @ factor if r["high"][j] > r["low"][j] else np.ones((len(x), 1))
        out = out * own[:, terms[:, j]]
    return out


def products(k: int, degree: int, gamma: float, coef0: float) -> tuple[list[tuple], np.ndarray]:
    """Products of columns whose weighted products are the polynomial kernel, and their weights."""
    terms = [t for d in range(degree + 1) for t in combinations_with_replacement(range(k), d)]
    ways = [factorial(degree) / (factorial(degree - len(t)) * prod(factorial(t.count(c)) for c in set(t))) for t in terms]
    return terms, np.array([w * gamma ** len(t) * coef0 ** (degree - len(t)) for w, t in zip(ways, terms)])


def kernel_ridge(blocks: DataFrame, k: int, alpha: float = 1.0, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 1.0, most: int = FEATURES) -> DataFrame:
    """row and fit of all blocks' rows."""
    gamma = 1 / k if gamma is None else gamma
    if kernel not in ("rbf", "poly", "polynomial", "linear"):
        raise ValueError(f"unknown kernel {kernel!r}")
    if kernel == "rbf":
        return gaussian_ridge(blocks, k, alpha, gamma, most)
    terms, weight = products(k, degree, gamma, coef0) if kernel != "linear" else ([(c,) for c in range(k)], np.ones(k))
    each = blocks.select("by").distinct()
    return solved_by_features(blocks, each, k, alpha, weight, lambda b: np.column_stack([np.prod(b.x[:, list(t)], axis=1) for t in terms]))


def solved_by_features(blocks: DataFrame, state: DataFrame, k: int, alpha: float, weight: np.ndarray | None, features) -> DataFrame:
    """Fits of the dates in `state`: with a kernel F S F', the coefficients of F are S (F'F S + alpha)^-1 F'y."""

    def part(b: Block) -> np.ndarray:
        f = features(b)
        return np.concatenate([[f.shape[1]], (f.T @ f).ravel(), f.T @ b.y])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        out[0] = a[0]
        return out

    def solve(r: dict) -> dict:
        m, s = int(r["sums"][0]), r["sums"][1:]
        s_of = np.ones(m) if weight is None else weight
        left = s[: m * m].reshape(m, m) * s_of + alpha * np.eye(m)
        return {"coef": s_of * (np.linalg.solve(left, s[m * m :]) if alpha else np.linalg.lstsq(left, s[m * m :], rcond=None)[0])}

    coef = cut_lineage(updated(summed(blocks.join(state, "by"), part, merge), solve, "coef array<double>"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(b.x[:, k].astype(np.int64)), pa.array(features(b) @ b.coef)], ["row", "fit"])

    return blocks.join(state, "by").join(coef, "by").mapInArrow(fitted, ROW)


def gaussian_ridge(blocks: DataFrame, k: int, alpha: float, gamma: float, most: int) -> DataFrame:
    shape = "low array<double>, high array<double>, shape array<double>, factor array<double>, terms array<double>"
    ends = summed(blocks, lambda b: np.concatenate([b.x[:, :k].min(0), -b.x[:, :k].max(0)]), np.minimum)
    none = {name.split()[0]: np.zeros(0) for name in shape.split(", ")}
    state = cut_lineage(updated(ends, lambda r: gaussian_features(r["sums"][:k], -r["sums"][k:], gamma, most) or none, shape))
    few, wide = state.where(F.size("factor") > 0), state.where(F.size("factor") == 0).select("by")
    out = solved_by_features(blocks, few, k, alpha, None, lambda b: gaussian_of(b.x[:, :k], vars(b)))
    return out if wide.isEmpty() else out.unionByName(by_gradients(blocks.join(wide, "by"), k, alpha, gamma))


def by_gradients(blocks: DataFrame, k: int, alpha: float, gamma: float) -> DataFrame:
    """(K + alpha) a = y by conjugate gradients for all dates at once, a product of tiles for each step; the fit is
    y - alpha a."""
    kind = blocks.schema["by"].dataType.simpleString()
    base = cut_lineage(blocks.select("by", F.monotonically_increasing_id().alias("block"), "n", "y", "x"))
    numbers = lambda v: np.frombuffer(v)

    def each(of, schema: str):
        """A row for each row, from a dictionary of its columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    more = of(r)
                    yield pa.RecordBatch.from_arrays([batch.column("by").slice(i, 1), *(pa.array([v]) for v in more.values())], ["by", *more])

        return lambda df: df.mapInArrow(run, f"by {kind}, {schema}")

    def tile(r: dict) -> dict:
        a, b = (numbers(r[c]).reshape(-1, k + 1)[:, :k] for c in ("xa", "xb"))
        return {"block": r["block"], "part": (kernel_of(a, b, "rbf", gamma) @ numbers(r["p"])).tobytes()}

    def added(rows: pa.Table) -> pa.Table:
        total = np.sum([numbers(v) for v in rows["part"].to_pylist()], axis=0)
        return pa.table({"block": rows["block"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    def dots(r: dict) -> dict:
        rest, p = numbers(r["r"]), numbers(r["p"])
        q = numbers(r["part"]) + alpha * p
        return {"block": r["block"], "q": q.tobytes(), "rr": float(rest @ rest), "pq": float(p @ q), "rq": float(rest @ q), "qq": float(q @ q)}

    def step(r: dict) -> dict:
        long = r["s_rr"] / r["s_pq"]
        p, q = numbers(r["p"]), numbers(r["q"])
        rest = numbers(r["r"]) - long * q
        left = max(r["s_rr"] - 2 * long * r["s_rq"] + long * long * r["s_qq"], 0.0)
        return {"block": r["block"], "a": (numbers(r["a"]) + long * p).tobytes(), "r": rest.tobytes(), "p": (rest + left / r["s_rr"] * p).tobytes(), "left": left}

    vectors = "block long, a binary, r binary, p binary, left double"
    start = each(lambda r: {"block": r["block"], "a": bytes(len(r["y"])), "r": r["y"], "p": r["y"], "left": float("inf")}, vectors)
    state, done = cut_lineage(start(base)), []
    goal = cut_lineage(base.groupBy("by").applyInArrow(lambda rows: pa.table({"by": rows["by"][:1], "goal": [NEAR**2 * sum(float(numbers(v) @ numbers(v)) for v in rows["y"].to_pylist())]}), f"by {kind}, goal double"))
    for _ in range(STEPS):
        over = state.join(goal, "by").withColumn("ends", F.col("left") <= F.col("goal")).drop("goal")
        done.append(over.where("ends").select("block", "a"))
        state = over.where(~F.col("ends")).drop("ends")
        if state.isEmpty():
            break
        left = base.select("by", "block", F.col("x").alias("xa"))
        right = state.join(base.select(F.col("block").alias("own"), F.col("x").alias("xb")), F.col("block") == F.col("own")).select("by", "xb", "p")
        parts = each(tile, "block long, part binary")(left.join(right, "by")).select("block", "part").groupBy("block").applyInArrow(added, "block long, part binary")
        q = cut_lineage(each(dots, "block long, q binary, rr double, pq double, rq double, qq double")(state.join(parts, "block")))
        sums = q.groupBy("by").agg(*(F.sum(c).alias(f"s_{c}") for c in ("rr", "pq", "rq", "qq")))
        state = cut_lineage(each(step, vectors)(state.join(q.select("block", "q"), "block").join(sums, "by")))
    else:
        raise ArithmeticError(f"conjugate gradients didn't settle in {STEPS} steps")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(numbers(r["x"]).reshape(-1, k + 1)[:, k].astype(np.int64)), pa.array(numbers(r["y"]) - alpha * numbers(r["a"]))], ["row", "fit"])

    return base.join(found, "block").select("x", "y", "a").mapInArrow(fitted, ROW)
