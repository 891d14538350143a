"""Numbers of a panel in blocks, and sums of arrays over the blocks of each date.

An estimator that takes several passes packs its columns once into blocks of at most ROWS rows of one date, and then asks
for sums: each task adds what its blocks of a date give, and one shuffle of these partial sums, a row for each date and
task, adds the rest.  So a cross-section may be of any size: no task holds it, and what is shuffled doesn't follow it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage

ROWS = 8192
#: Numbers that a task gathers before it gives them out.
GATHERED = 8_000_000

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def packed(df: DataFrame, by: str, key: Column, y: Column, x: list[Column], most: int = ROWS) -> DataFrame:
    """A written table of blocks: by, n, keys (64-bit hashes of `key`), y and x (rows times columns), as bytes.  Rows are
    dealt by date; Spark splits what is too large for a task, so a date may lie in several tasks."""
    rows = df.select(F.col(by), F.xxhash64(key).alias("key"), F.array(y, *x).cast("array<double>").alias("z"))
    k = len(x) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            edges = [0, *_changes(batch.column(by)), batch.num_rows]
            for a, b in ((c, min(c + most, d)) for s, d in zip(edges, edges[1:]) for c in range(s, d, most)):
                yield pa.RecordBatch.from_arrays([batch.column(by).slice(a, 1), pa.array([b - a], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (keys[a:b], z[a:b, 0], z[a:b, 1:]))], ["by", "n", "keys", "y", "x"])

    dealt = rows.hint("rebalance", F.col(by)).sortWithinPartitions(by)
    return cut_lineage(dealt.mapInArrow(pack, f"by {df.schema[by].dataType.simpleString()}, n int, keys binary, y binary, x binary"))


def _changes(column: pa.Array) -> list[int]:
    """Where a value differs from the one before; the rows are sorted."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return (np.flatnonzero(np.diff(codes)) + 1).tolist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """A block and what its date has in the other columns: numbers as they are, arrays as numpy."""

    def __init__(self, row: dict):
        self.n, self.keys, self.y = row["n"], np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["y"])
        self.x = np.frombuffer(row["x"]).reshape(self.n, -1)
        for name, value in row.items():
            if name not in ("n", "keys", "y", "x"):
                setattr(self, name, np.asarray(value) if isinstance(value, list) else value)


def summed(blocks: DataFrame, of: Callable[[Block], np.ndarray], combine: Combine = np.add) -> DataFrame:
    """by, sums: what the blocks of a date give, combined.  `combine` doesn't depend on order or grouping."""
    kind = blocks.schema["by"].dataType.simpleString()

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                add = of(Block(row))
                held[row["by"]] = combine(held[row["by"]], add) if row["by"] in held else add
                if sum(map(len, held.values())) > GATHERED:
                    yield out(held, batch.column("by").type)
                    held = {}
        if held:
            yield out(held, batch.column("by").type)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for by, sums in zip(batch.column("by").to_pylist(), batch.column("sums")):
                sums = sums.values.to_numpy()
                if total is not None and by == at:
                    total = combine(total, sums)
                    continue
                if total is not None:
                    yield out({at: total}, batch.column("by").type)
                at, total = by, sums
        if total is not None:
            yield out({at: total}, batch.column("by").type)

    def out(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(v) for v in held.values()])])
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(held.values())))).cast(pa.list_(pa.float64()))], ["by", "sums"])

    schema = f"by {kind}, sums array<double>"
    return blocks.mapInArrow(given, schema).repartition("by").sortWithinPartitions("by").mapInArrow(added, schema)


# -- moments: n, means and centred second moments of some columns in one array --


def moments_of(z: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The sum of weights, the means and the centred second moments (sums, not divided) of rows."""
    n = float(len(z)) if weight is None else weight.sum()
    if not n:
        return np.zeros(1 + z.shape[1] + z.shape[1] ** 2)
    mean = (z if weight is None else z * weight[:, None]).sum(0) / n
    d = z - mean
    return np.concatenate([[n], mean, ((d if weight is None else d * weight[:, None]).T @ d).ravel()])


def moments_combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together; sums of squares never leave their own means, so nothing cancels."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    k = int(round((-1 + (4 * len(a) - 3) ** 0.5) / 2))  # 1 + k + k * k numbers
    d = b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + d * (b[0] / n), a[k + 1 :] + b[k + 1 :] + (np.outer(d, d) * (a[0] * b[0] / n)).ravel()])


def parted(m: np.ndarray) -> tuple:
    """n, mx, my, sxx, sxy, syy of moments of (y, x...), divided by n."""
    k = int(round((-1 + (4 * len(m) - 3) ** 0.5) / 2))
    n, mean, s = m[0], m[1 : k + 1], m[k + 1 :].reshape(k, k) / max(m[0], 1e-300)
    return n, mean[1:], mean[0], s[1:, 1:], s[0, 1:], s[0, 0]


def pairs_of(z: np.ndarray) -> np.ndarray:
    """For all pairs of columns, over rows where both are present: rows, the first one's mean and squares, and products."""
    there = ~np.isnan(z)
    held = there.astype(float)
    shift = np.where(there, z, 0).sum(0) / np.maximum(held.sum(0), 1)
    d = np.where(there, z - shift, 0.0)
    n = held.T @ held
    s = d.T @ held / np.maximum(n, 1)
    return np.stack([n, shift[:, None] + s, (d * d).T @ held - n * s * s, d.T @ d - n * s * s.T]).ravel()


def pairs_combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = math.isqrt(len(a) // 4)
    a, b = a.reshape(4, k, k), b.reshape(4, k, k)
    n = a[0] + b[0]
    d, part = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0), a[0] * b[0] / np.maximum(n, 1)
    mean = np.where(a[0] > 0, a[1], b[1]) + d * b[0] / np.maximum(n, 1)
    return np.stack([n, mean, a[2] + b[2] + d * d * part, a[3] + b[3] + d * d.T * part]).ravel()


def both(b: Block) -> np.ndarray:
    """y and the columns of x side by side."""
    return np.column_stack([b.y, b.x])


def moments(blocks: DataFrame) -> DataFrame:
    return summed(blocks, lambda b: moments_of(both(b)), moments_combined)


def gram(df: DataFrame, by: str, columns: list[Column]) -> DataFrame:
    """by, sums: the moments of many columns in one pass over the frame, without packing or shuffling its rows.  Columns
    aren't null."""
    return over_rows(df, by, columns, moments_of, moments_combined)


def over_rows(df: DataFrame, by: str, columns: list[Column], of: Callable[[np.ndarray], np.ndarray], combine: Combine) -> DataFrame:
    """by, sums: what runs of rows of a date give, combined; null is NaN there."""
    k, kind = len(columns), df.schema[by].dataType.simpleString()

    def as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            dates = batch.column("by").dictionary_encode()
            codes = dates.indices.fill_null(len(dates.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(order)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield pa.RecordBatch.from_arrays([batch.column("by").slice(int(order[a]), 1), pa.array([b - a], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([z[order[a:b]].tobytes()], pa.binary())], ["by", "n", "keys", "y", "x"])

    rows = df.select(F.col(by).alias("by"), F.array(*columns).cast("array<double>").alias("z"))
    return summed(rows.mapInArrow(as_blocks, f"by {kind}, n int, keys binary, y binary, x binary"), lambda b: of(b.x), combine)


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """Columns of a row, arrays as numpy without a Python object for each number."""
    values = {c: batch.column(c)[i] for c in batch.schema.names}
    return {c: v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) and v.is_valid else v.as_py() for c, v in values.items()}


KINDS = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def updated(df: DataFrame, step: Callable[[dict], dict], schema: str) -> DataFrame:
    """A row for each row of a small frame: columns by and what `step` makes of it, of the KINDS that the schema names."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([("by", batch.schema.field("by").type), *((name, KINDS[kind]) for name, kind in fields)])
            rows = [{"by": r["by"], **step(r)} for r in (_row(batch, i) for i in range(batch.num_rows))]
            rows = [{c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in r.items() if c in kinds.names} for r in rows]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.mapInArrow(run, f"by {df.schema['by'].dataType.simpleString()}, {schema}")
