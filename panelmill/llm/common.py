"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words for near-duplicate work: runs of letters, digits and underscores.
WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and Spark runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written into the shared folder: compressed, read by column, with a size that Spark knows when
    it chooses joins, and there for executors that come after lost ones.  The folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession)}/panelmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(*tables: DataFrame) -> None:
    """Deletes tables of cut_lineage that no result needs any more."""
    for df in tables:
        context, paths = df.sparkSession.sparkContext, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for path in paths:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def small_enough(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit; beyond it Spark decides."""
    return F.broadcast(df) if rows <= limit else df


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `most` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ...: positions of many slices in a row."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and a 64-bit number of its lower-case form (the first character of
    it, where it has several).  The last entry stands for all points beyond the last letter of Unicode."""
    every = [chr(c) for c in range(0x32400)]
    word = np.fromiter((c.isalnum() or c == "_" for c in every), bool, len(every))
    lower = np.fromiter((ord(c.lower()[0]) for c in every), np.uint64, len(every))
    return word, mix(lower + np.uint64(1))


@lru_cache(maxsize=3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the power of 0 to n at least, modulo 2 ** 64; kept for later calls unless very long."""
    size = 1 << max(n, 1 << 16).bit_length()
    return _powers(size) if size <= 1 << 22 else _powers.__wrapped__(size)


class Hashed:
    """Values in a row, of which any run has a hash in constant time (polynomial sums modulo 2 ** 64)."""

    def __init__(self, values: np.ndarray):
        self.power, self.inverse = powers(len(values))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[: len(values)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass(frozen=True)
class Words:
    """The lower-case words of some texts in one row.  first: place of each text's first word and the total; start, end:
    code points in the own text; breaks: whether a line feed stands between a word and the one before it in its text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    breaks: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str]) -> Words:
    word, number = _characters()
    points = np.minimum(np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), len(word) - 1)
    inside = np.concatenate([np.zeros(1, bool), word[points], np.zeros(1, bool)])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begins)
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    breaks = np.zeros(len(start), bool)
    breaks[1:] = lines[start[1:]] > lines[end[:-1]]
    own = np.repeat(begins[:-1], np.diff(first))
    return Words(Hashed(number[points]).of(start, end), start - own, end - own, first, breaks)


def shingles_of(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of each text (of all its words together where there are fewer than n; none
    for no word), ascending within a text, and how many each has."""
    counts = np.where(words.counts > 0, np.maximum(words.counts - n + 1, 1), 0)
    at = ranges(words.first[:-1], counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = Hashed(words.hash).of(at, np.minimum(at + n, words.first[1:][owner]))
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts))


def lists_of(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Arrow lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def binaries_of(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow binaries of so many 64-bit values each."""
    ends = np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
    return whole.cast(pa.binary())


def squeezed(*columns: np.ndarray) -> bytes:
    """Integers of columns of one length, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(np.stack([c.astype(np.int64) for c in columns])).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes())


def released(data: bytes, columns: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(np.int64).reshape(columns, -1)
