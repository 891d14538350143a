"""The quality classifier and the repetition rules, restated in plain loops."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from panelmill.llm import quality, repetition, token_attribution
from panelmill.llm.queries import PATTERN, RANKS
from pyspark.sql import functions as F

S = quality.Settings(buckets=64, dims=6, ones=2)
TEXTS = [None, "", "The cat sat. The CAT!", "one two three 42 & one", "été naïve ÉTÉ", "BUY NOW $$$ " * 300, "The cat sat. The CAT!", "a " * 30 + "b"]


def words(text):
    """Buckets of the words: runs of letters, single digits, other marks; capitals of two letters or more keep their case."""
    found = re.findall(r"[^\W\d_]+|\d|[^\w\s]|_", text or "")
    return Counter(zlib.crc32((w if w.isupper() and len(w) > 1 else w.lower()).encode()) % S.buckets for w in found)


def plain_vectors(texts):
    sums, df = [[0] * S.dims for _ in range(S.buckets)], [0] * S.buckets
    for t in filter(None, texts):
        draw = np.random.default_rng(zlib.crc32(t.encode()))
        at, signs = draw.choice(S.dims, S.ones, replace=False), draw.choice([-1, 1], S.ones)
        for bucket, n in words(t).items():
            df[bucket] += 1
            for k, sign in zip(at, signs):
                sums[bucket][k] += min(n, 8) * sign
    total = [sum(row[k] for row in sums) for k in range(S.dims)]
    out = []
    for row, n in zip(sums, df):
        row = [v - t / sum(df) * n for v, t in zip(row, total)] if n else row
        length = math.sqrt(sum(v * v for v in row))
        out.append([v / max(length, 1e-6) for v in row])
    return np.array(out), np.array(df)


def plain_pool(text, vectors, weights):
    count = words(text)
    if not count:
        return np.zeros(2 * S.dims + 2)
    w = {b: n * weights[b] for b, n in count.items()}
    whole = sum(w.values())
    mean = sum(w[b] / whole * vectors[b] for b in w)
    spread = sum(w[b] / whole * vectors[b] ** 2 for b in w) - mean**2
    return np.concatenate([mean, np.sqrt(np.maximum(spread, 0)), [len(count) / sum(count.values()), math.log(1 + sum(count.values())) / 10]])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, 0.1, "x") for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0.1, "x"), (None, TEXTS[3], 0.1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, _text string").repartition(3)


def test_word_vectors_by_plain_loops(docs):
    vectors, df = quality.word_vectors(docs, S)
    want, seen = plain_vectors([r.text for r in docs.collect()])
    assert (df == seen).all() and np.allclose(vectors, want, atol=1e-5)


def test_scores_by_plain_loops(docs):
    vectors, df = plain_vectors(TEXTS)
    draw = np.random.default_rng(1)
    wide = 2 * S.dims + 2
    weights = np.log((df.max() + 1) / (df + 1)) + 0.1
    layers = draw.normal(size=(wide, 5)), draw.normal(size=5), draw.normal(size=5), draw.normal(size=1)
    mean, scale = draw.normal(size=wide), draw.uniform(0.5, 2, wide)
    model = quality.Model(vectors.astype(np.float32), weights.astype(np.float32), mean, scale, layers, 1.7, 0.5)
    got = quality.score(docs, model, S).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        x = (plain_pool(r.text, vectors, weights) - mean) / scale
        hidden = [max(sum(x[i] * layers[0][i][j] for i in range(wide)) + layers[1][j], 0) for j in range(5)]
        logit = sum(h * w for h, w in zip(hidden, layers[2])) + layers[3][0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit / 1.7)), abs=1e-5)


def test_temperature_is_the_best_of_its_grid(spark):
    """Held-out loss of the fitted model isn't lower at another temperature; repeated rows and null ids change nothing."""
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice("good fine plain" if k % 2 else "buy now !!!").upper() + draw.choice("abcdefg") for _ in range(20))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 if draw.random() < 0.9 else 1 - k % 2)) for k in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels, S)
    more = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    known = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    x = quality.pooled([known[0][k] for k in known[1]], model.vectors, model.weights, quality._Buckets(S.buckets)).astype(float)
    y = np.array([known[1][k] for k in known[1]], float)
    order = np.lexsort((*x.T[:8], y))
    x, y = x[order], y[order]
    fifth = np.random.default_rng(S.seed).permutation(len(y)) % 5 == 0
    z = model.logits(x[fifth])
    loss = lambda t: -np.mean(y[fifth] * np.log(1 / (1 + np.exp(-z / t))) + (1 - y[fifth]) * np.log(1 / (1 + np.exp(z / t))))
    assert all(loss(model.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 8, 61))
    again = quality.fit(docs, labels.unionByName(labels), S)
    assert again.temperature == model.temperature and all(np.array_equal(a, b) for a, b in zip(again.layers, model.layers))
    assert quality.score(more, model, S).count() == 143


def test_repetition_shares_and_verdict_by_plain_loops():
    draw = random.Random(5)
    limits = repetition.Limits()
    texts = ["", "x", "a b " * 40, "\n".join(["same line here today"] * 9), "\n".join(x for k in range(12) for x in ("longwordone longwordtwo", f"u{k} v{k} w{k} x{k}")), *("\n".join(" ".join(draw.choice(["w%d" % k for k in range(draw.choice([3, 12, 60]))]) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 14))) for _ in range(200))]
    verdicts = Counter()
    for text in texts:
        own = re.findall(r"[^ \t-\r]+", text)
        chars = sum(map(len, own))
        shares = []
        for n, _ in limits.ngram_share:
            grams = Counter(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
            inside = {i + k for i in range(len(own) - n + 1) if grams[tuple(own[i : i + n])] > 1 for k in range(n)}
            shares.append(sum(len(own[i]) for i in inside) / chars if chars else 0.0)
        lines = text.split("\n")
        repeated = sum(len(w) for i, x in enumerate(lines) if x in lines[:i] for w in re.findall(r"[^ \t-\r]+", x))
        share = repeated / chars if chars else 0.0
        *_, failed, kept, line_share, ngram_shares = repetition.measure(text, limits)
        assert line_share == pytest.approx(share) and ngram_shares == pytest.approx(shares)
        assert kept == (not failed and share <= limits.line_share and all(s <= most for s, (_, most) in zip(shares, limits.ngram_share)))
        verdicts[failed, kept] += 1
    assert set(verdicts) == {(True, False), (False, False), (False, True)}


def test_repeated_rows_are_attributed_each(spark):
    rows = [(1, "first line\nsecond"), (1, "first line\nsecond"), (2, None), (3, "é" * 50 + "\n\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.section, r.n_tokens) for r in token_attribution.section_tokens(docs, RANKS, PATTERN).collect())
    once = Counter((r.doc_id, r.section, r.n_tokens) for r in token_attribution.section_tokens(docs.dropDuplicates(), RANKS, PATTERN).collect())
    assert got == Counter({key: n * 2 if key[0] == 1 else n for key, n in once.items()})
