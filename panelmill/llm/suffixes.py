"""Removal of repeated byte strings by bucket-pointer refinement of suffixes, to the depth that decides.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: at a smaller (doc_id, start).  Suffixes are
grouped by their first LENGTH bytes as in a suffix array, in three steps; buckets with one member are final at once.

1. Initial buckets are q-grams of Q bytes, but only of suffixes that are anchors: the leftmost least q-gram of some window
   of LENGTH bytes.  Equal windows have equal anchors at equal offsets, so no equal windows are lost, and one suffix in
   35 is dealt out.  A bucket is refined by the identifier of all that the anchor's windows cover before and after it.
   Of anchors that agree in it all windows agree: the first one stays, all others are repeated as a whole.
2. First anchors of buckets with several classes (ends of passages, mostly) are refined by the identifiers of the halves
   before and after them.  Each window holds one half wholly, so windows whose half no other class has are final.
3. What is left are single windows.  Bucket pointers of 25 bytes at two offsets give pointers of 50, and these at offsets
   0 and 50 the order at depth 100: windows in one bucket are equal, and all but the first are repeated.

Identifiers are hashes of 96 bits and more in all.  Texts lie in portions, rows of a table with compressed texts, and only
one member of each class and portion leaves its portion.  Members are dealt into buckets of about a million, as compressed
columns of what a portion has in a bucket, and are sorted there.  An anchor string with more than `OFTEN` classes in a portion is dealt
by class, not by string, and says so to the other portions in one row, so no string, however frequent, makes a hot key.

Defined results: null and empty texts have no bytes and keep none; a null doc_id comes last; rows of one doc_id count as
one document, so only their earlier starts count, and rows that repeat doc_id and text all get the same result; an empty
table gives no rows; doc_id is read as a long integer; other columns aren't read; matches don't cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, cut_lineage, lists_of, mix, portions, ranges, released, squeezed

LENGTH, Q = 100, 25
WINDOW = LENGTH - Q + 1
#: Bytes before and after an anchor of which every window holds the former or the latter.
LEFT = (LENGTH - Q + 1) // 2
RIGHT = LENGTH - Q - LEFT + 1
OFTEN = 8
PORTION = 2_000_000
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = 2**63 - 1

ANCHOR, DEALT_BY_CLASS, TOLD = range(3)
PORTIONS = "portion long, docs array<long>, copies array<int>, sizes array<long>, texts binary"
#: What portions send to a bucket: columns of members; and spans of theirs that are decided already, in one of the rows.
DEALT = "bucket long, portion long, members binary, spans binary"
#: What buckets send back: spans (row, start, end), and anchors that aren't decided (row, place, halves) with their windows.
BACK = "portion long, spans binary, undecided binary, windows long"
BUCKET = 1_000_000
#: Bytes of text that have about one anchor.
BYTES_OF_ANCHOR = 35


def dealt(portion: int, part: np.ndarray, buckets: int, columns: tuple[np.ndarray, ...], steady: tuple[np.ndarray, ...], spans: tuple[np.ndarray, ...]) -> pa.Table:
    """Rows of DEALT.  `steady` columns change little from member to member, and are kept as differences."""
    to = (mix(part) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    names, first = np.unique(to[order], return_index=True)
    parts = [squeezed(*(c[i].view(np.int64) for c in columns), *(np.diff(c[i], prepend=0) for c in steady)) for i in np.split(order, first[1:])] if len(order) else []
    own = [squeezed(*spans)] if len(spans[0]) else []
    names = np.concatenate([names, np.full(len(own), portion % buckets)])
    return pa.table({"bucket": pa.array(names, pa.int64()), "portion": np.full(len(names), portion), "members": pa.array([*parts, *(None for _ in own)], pa.binary()), "spans": pa.array([*(None for _ in parts), *own], pa.binary())})


def gathered(rows: pa.Table, columns: int, steady: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns of a bucket's members, the place of each one's portion, and the portions."""
    there = rows.filter(rows["members"].is_valid())
    parts = [released(m, columns + steady) for m in there["members"].to_pylist()]
    if not parts:
        return [np.zeros(0, np.int64)] * (columns + steady), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = [np.concatenate([p[k] if k < columns else np.cumsum(p[k]) for p in parts]) for k in range(columns + steady)]
    return out, np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts]), there["portion"].to_numpy()


def sent_back(rows: pa.Table, portions: np.ndarray, owner: np.ndarray, later: np.ndarray, spans: tuple, undecided: np.ndarray, open_: tuple, windows: np.ndarray) -> pa.Table:
    """Rows of BACK: by portion what is repeated and what isn't decided, and the spans that came along."""
    out: dict[str, list] = {"portion": [], "spans": [], "undecided": [], "windows": []}
    for i, portion in enumerate(portions.tolist()):
        a, b = np.searchsorted(owner, [i, i + 1])
        gone, left = a + np.flatnonzero(later[a:b]), a + np.flatnonzero(undecided[a:b])
        if len(gone) or len(left):
            out["portion"].append(portion)
            out["spans"].append(squeezed(*merged(*(c[gone] for c in spans))) if len(gone) else None)
            out["undecided"].append(squeezed(*(c[left] for c in open_)) if len(left) else None)
            out["windows"].append(int(windows[left].sum()))
    along = rows.filter(rows["spans"].is_valid())
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
    own = pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})
    return pa.concat_tables([own, pa.table({"portion": along["portion"], "spans": along["spans"], "undecided": pa.nulls(len(along), pa.binary()), "windows": pa.array([0] * len(along), pa.int64())})])


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Portions of texts, each distinct (doc_id, text) once, compressed."""
    task = TaskContext.get().partitionId()
    for k, batch in enumerate(portions(batches, "text", most)):
        texts: dict[tuple, int] = {}
        for one in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            one = (one[0], one[1] or b"")
            texts[one] = texts.get(one, 0) + 1
        n = np.array([len(texts)])
        yield pa.RecordBatch.from_pydict({
            "portion": pa.array([(task << 32) + k], pa.int64()), "docs": pa.array([[d for d, _ in texts]], pa.list_(pa.int64())), "copies": lists_of(np.fromiter(texts.values(), np.int32, len(texts)), n),
            "sizes": lists_of(np.fromiter((len(t) for _, t in texts), np.int64, len(texts)), n), "texts": pa.array([zstandard.compress(b"".join(t for _, t in texts))], pa.binary()),
        })


class Portion:
    """A row of the packed table: data (bytes), begins (of the texts, and the end), docs (null is LAST) and the raw lists."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, i: int = 0):
        self.id = rows.column("portion")[i].as_py()
        self.doc_ids, self.copies = rows.column("docs")[i].as_py(), rows.column("copies")[i].as_py()
        self.data = np.frombuffer(zstandard.decompress(rows.column("texts")[i].as_py()), np.uint8)
        self.begins = np.concatenate([[0], np.cumsum(rows.column("sizes")[i].values.to_numpy())]).astype(np.int64)
        self.docs = np.array([LAST if d is None else d for d in self.doc_ids], np.int64)


def anchors(data: np.ndarray, begins: np.ndarray, strings: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi: the windows from start lo to before hi share an anchor; at, its place; and the q-gram's identifier there.
    The anchor of a window is its least q-gram by identifier, the leftmost of equal ones."""
    n = len(data) - Q + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    starts = np.arange(n)
    grams = strings.of(starts, starts + Q)
    least, span = grams, 1
    while span < WINDOW:  # least of twice as many at each turn
        more = min(span, WINDOW - span)
        least, span = np.minimum(least[:-more], least[more:]), span + more
    size = np.diff(begins)
    whole = np.zeros(len(data) + 1, np.int32)
    np.add.at(whole, begins[:-1][size >= LENGTH], 1)
    np.add.at(whole, begins[1:][size >= LENGTH] - LENGTH + 1, -1)
    whole = np.cumsum(whole)[: len(least)] > 0  # windows inside one text
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    change[begins[:-1][size >= LENGTH]] = True
    lo = np.flatnonzero(change & whole)
    stops = np.append(np.flatnonzero(change | ~whole), len(least))
    hi = stops[np.searchsorted(stops, lo, side="right")]
    at = lo + WINDOW - 1  # where a lesser q-gram came in at the end
    inner = np.flatnonzero(~((lo > 0) & whole[lo - 1] & (least[lo] < least[lo - 1])))
    for some in np.array_split(inner, len(inner) // 50_000 + 1):
        at[some] = lo[some] + np.argmin(grams[lo[some][:, None] + np.arange(WINDOW)], axis=1)
    return lo, hi, at, grams[at]


def firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether no row with the same keys has a smaller (doc, place)."""
    order = np.lexsort((place, doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = (doc[order] == doc[head]) & (place[order] == place[head])
    return out


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, united where they overlap or touch."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    shift = row.astype(np.int64) * (int(end.max()) + 2)  # so that a running maximum stays within a row
    reach = np.maximum.accumulate(end + shift) - shift
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], start[new], reach[last]


def anchor_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT: the first of each class in its portion, what is told of frequent strings, and spans of the rest."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = Portion(batch, i)
            strings = Hashed(BYTE[own.data])
            lo, hi, at, gram = anchors(own.data, own.begins, strings)
            row = np.searchsorted(own.begins, lo, side="right") - 1
            start, doc = lo - own.begins[row], own.docs[row]
            end = np.minimum(at + Q + RIGHT, own.begins[row + 1])
            before = np.where(at - lo >= LEFT, strings.of(np.maximum(at - LEFT, 0), at), np.uint64(0)) >> np.uint64(48)
            after = np.where(hi + LENGTH - 1 >= at + Q + RIGHT, strings.of(at + Q, end), np.uint64(0)) >> np.uint64(48)
            shape = ((at - lo) << 8 | (hi - lo)).astype(np.uint64)
            cover = mix(strings.of(lo, hi + LENGTH - 1) * np.uint64(3) + shape)
            label = before << np.uint64(48) | cover >> np.uint64(16)
            place = start << 32 | after.astype(np.int64) << 16 | shape.astype(np.int64)
            first = firsts((label, gram), doc, place)
            _, string = np.unique(gram, return_inverse=True)
            # a class counts once, though rows of one place in one doc_id are all first
            order = np.lexsort((label, string))
            new = np.ones(len(order), bool)
            new[1:] = (string[order][1:] != string[order][:-1]) | (label[order][1:] != label[order][:-1])
            often = np.bincount(string[order][new], minlength=int(string.max(initial=-1)) + 1) > OFTEN
            by_class = often[string]
            told = np.unique(gram[by_class])
            spans = merged(row[~first], start[~first], (start + hi - lo + LENGTH - 1)[~first])
            part = np.concatenate([np.where(by_class, mix(gram + label * ODD), gram)[first], told])
            rest = np.zeros(len(told), np.int64)
            kind = np.concatenate([np.where(by_class, DEALT_BY_CLASS, ANCHOR)[first], rest + TOLD])
            fixed = part, np.concatenate([label[first], rest.view(np.uint64)]), np.concatenate([(place & 0xFFFFFFFF)[first], rest]), kind
            steady = tuple(np.concatenate([c[first], rest]) for c in (row, start, doc))
            yield from dealt(own.id, part, buckets, fixed, steady, spans).to_batches()


def shared(key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether a key stands with several labels."""
    order = np.lexsort((label, key))
    new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    new[1:] = new_key[1:] | (label[order][1:] != label[order][:-1])
    group = np.cumsum(new_key) - 1
    out = np.empty(len(order), bool)
    out[order] = (np.bincount(group, weights=new) > 1)[group] if len(order) else False
    return out


def refined(rows: pa.Table) -> pa.Table:
    """A bucket of anchors: all but the first of a class are repeated; the first ones of strings with several classes are
    undecided, where another class has the half before or the half after them too."""
    (part, label, low, kind, row, start, doc), owner, portions = gathered(rows, 4, 3)
    part, label, place = part.view(np.uint64), label.view(np.uint64), start << 32 | low
    anchor = kind != TOLD
    first = firsts((label, part), doc, place)
    several = shared(part, label) | (kind == DEALT_BY_CLASS)
    _, string = np.unique(part, return_inverse=True)
    sure = (kind == DEALT_BY_CLASS) | (np.bincount(string, weights=~anchor) > 0)[string]
    again = anchor & first & several
    at = np.flatnonzero(again)
    halves = np.zeros(len(part), np.int64)
    for bit, half in ((1, label >> np.uint64(48)), (2, (place >> 16 & 0xFFFF).astype(np.uint64))):
        halves[at] |= np.where(sure[at] | shared(mix(part[at] + mix(half[at] + ODD)), label[at]), bit, 0)
    shape = place & 255
    return sent_back(rows, portions, owner, anchor & ~first, (row, start, start + shape + LENGTH - 1), halves > 0, (row, place, halves), shape)


def window_rows(packed_row: pa.Table, undecided: pa.Table, buckets: int) -> pa.Table:
    """Rows of DEALT of a portion: the first of each open window in it, and spans of the others."""
    parts = [released(u, 3) for u in undecided["undecided"].to_pylist()]
    if not packed_row.num_rows or not parts:
        return pa.schema([("bucket", pa.int64()), ("portion", pa.int64()), ("members", pa.binary()), ("spans", pa.binary())]).empty_table()
    own = Portion(packed_row)
    strings = Hashed(BYTE[own.data])
    row, place, halves = np.concatenate(parts, axis=1)
    order = np.lexsort((place, row))
    row, place, halves = row[order], place[order], halves[order]
    lo = own.begins[row] + (place >> 32)
    end = lo + (place & 255)
    middle = np.clip(lo + (place >> 8 & 255) - LEFT + 1, lo, end)  # windows before `middle` hold the half before
    first, last = np.where(halves & 1, lo, middle), np.where(halves & 2, end, middle)
    p, row = ranges(first, last - first), np.repeat(row, last - first)
    pointer = lambda at: strings.of(at, at + Q)  # noqa: E731  25 bytes
    twice = lambda at: mix(pointer(at) * ODD + pointer(at + Q))  # noqa: E731  50 bytes
    part, label = twice(p), twice(p + 2 * Q) >> np.uint64(32)
    start, doc = p - own.begins[row], own.docs[row]
    keep = firsts((label, part), doc, start)
    spans = merged(row[~keep], start[~keep], start[~keep] + LENGTH)
    return dealt(own.id, part[keep], buckets, (part[keep], label[keep]), (row[keep], start[keep], doc[keep]), spans)


def ordered(rows: pa.Table) -> pa.Table:
    """A bucket of windows: all but the first of equal ones are repeated."""
    (part, label, row, start, doc), owner, portions = gathered(rows, 2, 3)
    later = ~firsts((label, part), doc, start)
    return sent_back(rows, portions, owner, later, (row, start, start + LENGTH), np.zeros(len(part), bool), (), start)


KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def cut_out(packed_row: pa.Table, spans: pa.Table) -> pa.Table:
    """Rows of KEPT of a portion."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    if not packed_row.num_rows:
        return kinds.empty_table()
    own = Portion(packed_row)
    parts = [released(p, 3) for p in spans["spans"].to_pylist()]
    row, start, end = merged(*(np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)))
    stay = np.ones(len(own.data) + 1, bool)
    edge = np.zeros(len(own.data) + 1, np.int32)
    np.add.at(edge, own.begins[row] + start, 1)
    np.add.at(edge, own.begins[row] + end, -1)
    stay = np.cumsum(edge) == 0
    at = np.searchsorted(row, np.arange(len(own.docs) + 1))
    out: dict[str, list] = {c: [] for c in kinds.names}
    for i, (doc, copies) in enumerate(zip(own.doc_ids, own.copies)):
        a, b = own.begins[i], own.begins[i + 1]
        kept = own.data[a:b][stay[a:b]].tobytes()
        gone = [{"start": s, "end": e} for s, e in zip(start[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist())]
        for c, v in zip(out, (doc, int(b - a), int(b - a) - len(kept), gone, kept)):
            out[c] += [v] * copies
    return pa.Table.from_pydict(out, schema=kinds)


def without_repeats(documents: DataFrame, portion: int = PORTION) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, spans (maximal removed runs: byte start, end) and kept, the
    bytes that are left, which may begin or end within a character."""
    texts = cut_lineage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: packed(batches, portion), PORTIONS))
    size = texts.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = 1 + size // (BYTES_OF_ANCHOR * BUCKET)
    by_portion = lambda df: df.groupBy("portion")
    decided = cut_lineage(texts.mapInArrow(lambda batches: anchor_rows(batches, buckets), DEALT).groupBy("bucket").applyInArrow(refined, BACK))
    more = 1 + (decided.agg(F.sum("windows")).first()[0] or 0) // BUCKET
    undecided = decided.where("undecided IS NOT NULL").select("portion", "undecided")
    windows = by_portion(texts).cogroup(by_portion(undecided)).applyInArrow(lambda text, left: window_rows(text, left, more), DEALT)
    found = cut_lineage(windows.groupBy("bucket").applyInArrow(ordered, BACK))
    spans = decided.unionByName(found).where("spans IS NOT NULL").select("portion", "spans")
    return by_portion(texts).cogroup(by_portion(spans)).applyInArrow(cut_out, KEPT)
