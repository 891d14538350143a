"""Operators 11 to 13 against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from panelmill.llm import merkle, phrases, queries, suffixes
from panelmill.llm.common import Hashed
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, portion string, words int, kids int, path string"


def table(spark, rows):
    """doc_id, text, lang; the other columns clash with names that operators use."""
    return spark.createDataFrame([(d, t, g, None if d is None else f"s{d % 3}", None if t is None else len(t), "x", 1, 2, "p") for d, t, g in rows], DOCS)


# -- suffixes --


def repeated(rows, n=100):
    first, key = {}, lambda d: (d is None, d or 0)
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], ((True, 1 << 63), 0)), (key(d), p))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < (key(d), p):
                gone[p : p + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[: len(b)], [False]])))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), edges[::2].tolist(), edges[1::2].tolist(), kept))
    return sorted(out, key=str)


def removed(docs, portion=suffixes.PORTION):
    rows = suffixes.without_repeats(docs, portion).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [s.start for s in r.spans], [s.end for s in r.spans], bytes(r.kept)) for r in rows), key=str)


def hostile_texts():
    draw = random.Random(7)
    word = lambda n, letters="abcdefgh ": "".join(draw.choice(letters) for _ in range(n))
    passage, line, long = word(240), word(130, "xyz "), word(900)
    texts = [word(draw.randint(0, 60)) + passage + word(draw.randint(0, 60)) for _ in range(40)]  # one string, many classes
    texts += [long, long[:450] + "é" + long[450:], long[100:], long, long[:99], long[:100], long[:101], "a" * 400, "ab" * 180, "a" * 250, word(99)]
    texts += [line * 3, line + "\n" + line, (line[:70] + word(5)) * 4, "日本語" * 60, "x日本語" * 50, "", None, passage[:100], passage[1:101]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_against_brute_force(spark, seed):
    texts = hostile_texts()
    draw = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, texts[40]), (None, "null id " + texts[41]), (3, texts[3]), (3, texts[3]), (5, texts[0]), (5, "b" * 300), (5, "b" * 300)]
    draw.shuffle(rows)
    assert removed(table(spark, [(d, t, "en") for d, t in rows]).repartition(3), 3_000) == repeated(rows)


def test_suffixes_across_portions_of_one_text_each(spark):
    rows = list(enumerate(hostile_texts()))
    assert removed(table(spark, [(d, t, "en") for d, t in rows]).repartition(4), 1) == repeated(rows)


def test_suffixes_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 40)
    rows = list(enumerate(hostile_texts()))
    assert removed(table(spark, [(d, t, "en") for d, t in rows]).repartition(4), 2_000) == repeated(rows)


def test_suffixes_of_no_rows(spark):
    assert removed(table(spark, [])) == [] and removed(table(spark, [(1, None, None), (2, "", None)])) == [(1, 0, 0, [], [], b""), (2, 0, 0, [], [], b"")]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij"])
def test_anchors_are_leftmost_least_grams(letters):
    draw = random.Random(len(letters))
    texts = ["".join(draw.choice(letters) for _ in range(n)).encode() for n in (0, 99, 100, 101, 180, 500, 5, 350)]
    data, begins = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    strings = Hashed(suffixes.BYTE[data])
    lo, hi, at, gram = suffixes.anchors(data, begins, strings)
    starts = np.arange(len(data) - suffixes.Q + 1)
    grams = strings.of(starts, starts + suffixes.Q)
    want = {p: p + int(np.argmin(grams[p : p + suffixes.WINDOW])) for a, b in zip(begins, begins[1:]) for p in range(a, b - suffixes.LENGTH + 1)}
    assert {p: a for x, y, a in zip(lo, hi, at) for p in range(x, y)} == want and (grams[at] == gram).all()


# -- phrases --


def mined(rows, least, longest, top):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in phrases.END.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = tuple(w for w in piece.replace("\t", " ").split(" ") if w)
            total[lang] += len(words)
            counts.update((lang, words[s : s + k]) for k in range(1, longest + 1) for s in range(len(words) - k + 1))
    frequent = {key: a for key, a in counts.items() if a >= least}
    out = {}
    for (lang, p), a in frequent.items():
        inside = any(g == lang and len(q) > len(p) and b >= a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for (g, q), b in frequent.items())
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    draw = random.Random(3)
    vocabulary = ["the", "THE", "of", "new", "York", "été", "Été", "naïve", "x", "of of", "\tq"]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "?!"]) for _ in range(draw.randint(0, 60)))
    rows = [(k, text(), draw.choice(["en", "fr", None, "und", ""])) for k in range(150)]
    return [*rows, *rows[:20], (None, None, "en"), (7, "", None), (8, "new york " * 400, "en"), (9, "of " * 300, "fr"), (10, "alone", "zz")]


@pytest.mark.parametrize("portion", [6_000_000, 300])
def test_phrases_against_brute_force(spark, monkeypatch, portion):
    monkeypatch.setattr(phrases, "BUCKET", portion // 10)
    rows = phrase_rows()
    got = phrases.collocations(table(spark, rows).repartition(3), least=5, longest=5, top=60, portion=portion)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 5, 5, 60)


def test_phrases_of_no_rows_and_of_rare_words(spark):
    assert phrases.collocations(table(spark, [])).collect() == [] and phrases.collocations(table(spark, [(1, "a b", "en"), (2, None, None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(["a", "b", "c"], 10**13, [10**15, 3 * 10**14, 10**13], [2 * 10**15, 5 * 10**14, 10**13], 10**17)], "words array<string>, a long, pre array<long>, suf array<long>, n long")
    best = row.select(phrases.lowest_cut().alias("b")).first().b
    assert tuple(best) == min((1000 * 10**13 * 10**17 // (l * r), k, l, r) for k, l, r in ((1, 10**15, 5 * 10**14), (2, 3 * 10**14, 2 * 10**15)))


# -- manifest --


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its path of (left, right)."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in groups[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            merged.append([i for g in groups[a : a + 8] for i in g])
        nodes, groups = above, merged
    return nodes[0], paths


def proofs(rows):
    langs = sorted({r.lang for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        own = sorted((r for r in rows if r.lang == g), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees[g] = (own, *tree([leaf_of(r, r.text) for r in own]))
    root, upper = tree([trees[g][1] for g in langs])
    out = []
    for g, above in zip(langs, upper):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths):
            whole, text = [*path, *above], r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in whole:
                node = sha(left + node + right)
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, sha("".join(a + b for a, b in whole)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("sizes", "digits"), [((1,), 3), ((1, 1), 3), ((8, 9, 1), 3), ((600, 64, 65, 1, 7), 3), ((150, 9), 1), ((70, 513, 2), 2)])
def test_manifest_against_brute_force(spark, monkeypatch, sizes, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    names = [None, "", "de", "en", "été", "zz"]
    rows = [(k * 7 % 1000, f"Text {k} É" if k % 5 else None, names[g]) for g, n in enumerate(sizes) for k in range(n)]
    if len(rows) > 600:
        rows += [(None, "Null id", "de"), (3, "Same id", "de"), (3, "Same row", "en"), (3, "Same row", "en"), (4, "", "en")]
    docs = table(spark, rows).repartition(5)
    got = merkle.manifest(docs, merkle.is_tampered()).drop("path").collect()
    assert sorted((tuple(r) for r in got), key=str) == proofs(docs.collect())


def test_manifest_finds_tampering_of_any_kind(spark):
    docs = table(spark, [(k, f"text {k}", "en" if k % 2 else None) for k in range(40)])
    got = {r.doc_id: r.verified for r in merkle.manifest(docs, F.col("doc_id") == 17, lambda t: F.concat(t, F.lit("."))).collect()}
    assert [k for k, ok in got.items() if not ok] == [17] and len(got) == 40
    assert merkle.manifest(table(spark, [])).collect() == []


def test_queries_of_this_file_are_registered():
    assert {"op11_collocations", "op12_merkle_manifest", "op13_suffix_dedup"} <= set(queries.QUERIES)


# -- windows that many items share (decontamination) --


def test_items_that_share_windows(spark):
    from panelmill.llm import decontaminate

    line = "answer the question below in one short and plain sentence please now"  # three windows
    rows = [(k, f"{line} item{k} own{k} words{k}", "en") for k in range(3)] + [(7, f"x {line} y {line}", "en"), (7, f"x {line} y {line}", "en"), (8, line.replace("short", "long"), "en"), (9, None, "en")]
    items = [(f"i{k}", f"{line} item{k} own{k}") for k in range(90)] + [("i5", f"{line} item5 own5"), ("short", "item2 own2"), ("none", None), (None, line)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(table(spark, rows), bench, within=30).collect()}
    every = sorted(f"i{k}" for k in range(90))
    assert [(got[k].n_hit, got[k].n_items) for k in (0, 1, 2, 7, 8, 9)] == [(14, 90), (14, 90), (14, 91), (24, 90), (0, 0), (0, 0)]
    assert got[7].items_sha256 == hashlib.sha256(",".join(every).encode()).hexdigest() and got[8].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].items_sha256 == hashlib.sha256(",".join(sorted([*every, "short"])).encode()).hexdigest()
    assert {(r.start, r.end) for r in decontaminate.phrase_matches(table(spark, rows[3:4]), bench).collect()} == {(1 + k, 11 + k) for k in range(3)} | {(14 + k, 24 + k) for k in range(3)}
