"""Byte-level BPE by merge replay with an inverted index.

Texts are cut into chunks at spaces, and chunks into pieces by the pattern; only chunks that a worker doesn't remember are
cut into pieces.  All pieces of a portion of texts that it hasn't seen become one row of tokens, with an inverted index from
the rank of each mergeable pair to its positions.  Ranks are replayed in order: each merge goes to all positions of its
index entry at once, and only the two neighbours of each are looked up again.  Ids of whole texts are then gathered from
the ids of chunks.  Documents stay where they are; nothing is shuffled.

The replay takes a portion's vocabulary, not the whole corpus's: every task needs the ids of nearly all its pieces, the
vocabulary of a corpus grows without bound, so that it can't be broadcast, and a join would move every piece of every text.
A worker keeps what it has replayed for its next portions and tasks.

Defined results: null text is empty, an empty text has no ids; any length of text works, since texts are handled in
portions and chunks are remembered up to a bound; repeated rows give repeated rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists_of, portions, ranges, texts_of

#: Chunks that a worker remembers at most before it starts afresh, the longest that it remembers, bytes of a portion.
REMEMBERED, LONGEST, PORTION = 200_000, 64, 2_000_000

#: A pattern whose pieces never go past the end of a chunk, and the chunks: what stands up to the next space
#: or line end with one space before it, or spaces as that pattern takes them.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")


class _Numbers(dict):
    """Chunk -> number, in the order of first sight; `new` has those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.n, self.new = 0, []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = self.n
        self.n += 1
        self.new.append(chunk)
        return number


class Ids:
    """Lists of ids in one row: list k has count[k] ids from start[k] on."""

    def __init__(self, flat: np.ndarray, count: np.ndarray):
        self.flat, self.count, self.start = flat, count, np.cumsum(count) - count

    def take(self, which: np.ndarray) -> np.ndarray:
        """The ids of these lists, one after the other."""
        return self.flat[ranges(self.start[which], self.count[which])]

    def followed_by(self, more: Ids) -> Ids:
        return Ids(np.concatenate([self.flat, more.flat]), np.concatenate([self.count, more.count]))


NOTHING = Ids(np.zeros(0, np.int32), np.zeros(0, np.int64))


class BytePairEncoder:
    """Ranks as in tiktoken's rank files: a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_start = np.cumsum(self.size) - self.size
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        split = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(split))) if split else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64) - 1)
        digits = [f"{k},".encode() for k in range(len(self.tokens))]
        self.digit_count = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_start = np.cumsum(self.digit_count) - self.digit_count
        self.pieces = regex.compile(pattern)
        self.chunks = CHUNK if pattern == SPACE_LED else self.pieces
        self.known, self.pool = _Numbers(), NOTHING

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of two tokens' bytes together, or -1; tokens of -1 have no pairs."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def replay(self, pieces: list[bytes]) -> Ids:
        """Ids of each piece: every merge in rank order over all pieces at once."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = np.append(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # the last entry is no token
        n, owner = len(token) - 1, np.repeat(np.arange(len(pieces)), length)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.cumsum(length) - 1] = before[np.cumsum(length) - length] = after[n] = n
        pair = self.rank_of(token, token[after])
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        ranks, first = np.unique(pair[order], return_index=True)
        index = dict(zip(ranks.tolist(), ([p] for p in np.split(order, first[1:]))))
        fresh: dict[int, list[int]] = {}
        queue = ranks.tolist()
        heapify(queue)
        while queue:
            rank = heappop(queue)
            at = np.concatenate([*index.pop(rank, ()), np.array(fresh.pop(rank, ()), np.int64)])
            at = at[pair[at] == rank]  # an earlier merge took one of the two otherwise
            if not len(at):
                continue
            every = at = np.unique(at)
            right = after[at]
            if (chained := at[1:] == right[:-1]).any():  # aaa: leftmost first
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                right = after[at]
            ahead, behind = after[right], before[at]
            left = np.where(np.concatenate([[False], behind[1:] == right[:-1]]), rank, token[behind])  # as it is after earlier merges
            new_left, new_right = self.rank_of(left, np.int64(rank)), self.rank_of(np.int64(rank), token[ahead])
            early = ((new_left >= 0) & (new_left < rank)) | ((new_right >= 0) & (new_right < rank))
            if early.any():  # a lower rank comes up: in those pieces only the first merge goes before it
                own = owner[at]
                late = np.isin(own, own[early])
                fine = ~late | np.concatenate([[True], own[1:] != own[:-1]])
                fresh[rank] = np.setdiff1d(every[np.isin(owner[every], own[late])], at[fine]).tolist()
                heappush(queue, rank)
                at, right = at[fine], right[fine]
                ahead, behind = after[right], before[at]
            token[at], token[right], pair[right] = rank, -1, -1
            after[at] = ahead
            before[ahead] = at  # entry n is never read
            pair[at] = self.rank_of(np.int64(rank), token[ahead])
            pair[behind] = self.rank_of(token[behind], np.int64(rank))
            pair[n] = -1
            touched = np.concatenate([at, behind])
            came = pair[touched]
            for r, p in zip(came[came >= 0].tolist(), touched[came >= 0].tolist()):
                if r in fresh:
                    fresh[r].append(p)
                else:
                    fresh[r] = [p]
                    if r not in index:
                        heappush(queue, r)
        left = token[:n] >= 0
        return Ids(token[:n][left].astype(np.int32), np.bincount(owner[left], minlength=len(pieces)))

    def _learn(self) -> None:
        """Puts the ids of the chunks that are new into the pool."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        numbers: dict[str, int] = {}
        cuts = [self.pieces.findall(chunk) for chunk in new] if self.chunks is CHUNK else [[chunk] for chunk in new]
        pieces = np.fromiter((numbers.setdefault(p, len(numbers)) for cut in cuts for p in cut), np.int64)
        raw = [p.encode() for p in numbers]
        whole = np.fromiter((self.ranks.get(p, -1) for p in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0)
        ids = Ids(whole[whole >= 0].astype(np.int32), np.ones(int((whole >= 0).sum()), np.int64)).followed_by(self.replay([raw[k] for k in rest]))
        place = np.empty(len(raw), np.int64)
        place[np.concatenate([np.flatnonzero(whole >= 0), rest])] = np.arange(len(raw))
        count = ids.count[place]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        self.pool = self.pool.followed_by(Ids(ids.take(place[pieces]), np.add.reduceat(count[pieces], np.cumsum(sizes) - sizes)))
        for chunk in new:
            if len(chunk) > LONGEST:
                del self.known[chunk]

    def encode_all(self, texts: list[str]) -> Ids:
        """The ids of each text."""
        if len(self.known) > REMEMBERED or len(self.pool.flat) > 20 * REMEMBERED:
            self.known, self.pool = _Numbers(), NOTHING
        number, cut = self.known.__getitem__, self.chunks.findall
        numbers = [np.fromiter(map(number, cut(text)), np.int32) for text in texts]
        self._learn()
        count = np.fromiter((self.pool.count[k].sum() for k in numbers), np.int64, len(texts))
        return Ids(self.pool.take(np.concatenate([np.zeros(0, np.int32), *numbers])), count)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids = self.encode_all(texts)
        return [ids.flat[a : a + n].tolist() for a, n in zip(ids.start, ids.count)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[ranges(self.token_start[ids], self.size[ids])]

    def decimals_of(self, ids: np.ndarray) -> np.ndarray:
        """The ids as decimals with a comma after each."""
        return self.digits[ranges(self.digit_start[ids], self.digit_count[ids])]

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.bytes_of(np.fromiter(ids, np.int64)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One for each worker process."""
    return BytePairEncoder.from_file(path, pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str, text: str = "text", round_trip: bool = False) -> DataFrame:
    """All columns and ids array<int>, the tokens of the whole text; a column of that name is replaced.  round_trip: also
    a boolean column of that name, whether the ids decode to the text, found out in the same worker."""
    kept = documents.drop("ids", *(["round_trip"] if round_trip else []))
    schema = kept.withColumn("ids", F.array().cast("array<int>"))
    schema = (schema.withColumn("round_trip", F.lit(True)) if round_trip else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in portions(batches, text, PORTION):
            texts = texts_of(batch, text)
            ids = own.encode_all(texts)
            columns = [*batch.columns, lists_of(ids.flat, ids.count)]
            if round_trip:
                columns.append(pa.array([own.bytes_of(ids.flat[a : a + n]).tobytes() == t.encode() for a, n, t in zip(ids.start, ids.count, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def decode_documents(documents: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns and decoded binary, the bytes of the ids; null ids give no bytes."""
    kept = documents.drop("decoded")
    schema = kept.withColumn("decoded", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            out = pa.array([own.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else ()) for x in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def _digests(values: np.ndarray, count: np.ndarray, less: int) -> pa.Array:
    """SHA-256 of each stretch of bytes, of which the last `less` bytes are left out."""
    ends, whole = np.cumsum(count), memoryview(np.ascontiguousarray(values))
    return pa.array([hashlib.sha256(whole[a : max(a, b - less)]).hexdigest() for a, b in zip((ends - count).tolist(), ends.tolist())], pa.string())


def digests(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, so that
    ids never leave the worker."""
    source = documents.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_tokens long, ids_sha256 string, decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in portions(batches, "_text", PORTION):
            ids = own.encode_all(texts_of(batch, "_text"))
            text_of = np.repeat(np.arange(len(ids.count)), ids.count)
            total = lambda size: np.bincount(text_of, weights=size[ids.flat], minlength=len(ids.count)).astype(np.int64)  # noqa: E731, B023
            of_ids = _digests(own.decimals_of(ids.flat), total(own.digit_count), 1)
            of_bytes = _digests(own.bytes_of(ids.flat), total(own.size), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids.count), of_ids, of_bytes], [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, fields)
