"""Operators on small tables with nulls, empty and long texts, repeated rows and clashing names, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from panelmill.llm import bpe, chat_format, decontaminate, links, neardup, passages, pii, quality, repetition, sharding, token_attribution
from panelmill.llm.common import WORD
from panelmill.llm.queries import PATTERN, QUERIES, RANKS, held_out
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("ane", "ilo", "ust", "orem", "ax")]


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[zlib.crc32(f"{seed}:{i}".encode()) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 200)
    edited = base.replace(base.split()[50], "changed", 1)
    return [None, "", "  \n ", "short text", base, base, edited, base.upper(), prose(2, 150), prose(3, 6000), "x" * 30_000, "lone " + prose(4, 60) + " end", "other words first. " + prose(4, 60) + " tail", "mail a@b.co and 1.2.3.4", prose(1, 200)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, 1, 2, 3, 4, "t", [9]) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a row that repeats
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score int, _text string, ids array<int>")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe_round_trip(docs, empty):
    out = bpe.decode_documents(bpe.encode_documents(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(out) == docs.count() and all(bytes(r.decoded).decode() == (r.text or "") for r in out)
    d = {r.doc_id: r for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    for r in out:
        assert d[r.doc_id].n_tokens == len(r.ids) and d[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encode_documents(empty, RANKS, PATTERN).count() == bpe.digests(empty, RANKS, PATTERN).count() == 0


def test_section_tokens_sum_to_the_document(docs, empty, texts):
    rows = token_attribution.section_tokens(docs.dropDuplicates(["doc_id"]), RANKS, PATTERN, rule="split").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(range(len(texts)))
    for i, own in by.items():
        own.sort(key=lambda r: r.section)
        assert own[0].char_start == 0 and own[-1].char_end == len(texts[i] or "") and all(a.char_end == b.char_start for a, b in zip(own, own[1:]))
        assert sum(r.n_tokens for r in own) == pytest.approx(own[0].doc_tokens)
    assert token_attribution.section_tokens(empty, RANKS, PATTERN).count() == 0


def test_pii_and_repetition_rows(docs, empty):
    assert {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}[13] == "email:5:11,ip:16:23"
    assert [r.text for r in pii.redact(docs).where("doc_id IN (0, 13)").orderBy("doc_id").collect()] == [None, "mail [EMAIL] and [IP]"]
    kept = {r.doc_id: r.kept for r in repetition.score_repetition(docs).collect()}
    assert kept[8] and kept[4] and not kept[0] and not kept[3]
    assert pii.find_spans(empty).count() == pii.redact(empty).count() == repetition.score_repetition(empty).count() == 0


def test_chat_ties_are_ordered_as_they_came(spark):
    """One turn number with texts of which one is escaped."""
    rows = [(1, 0, "user", "[INST]"), (1, 0, "user", "a"), (1, 0, "assistant", "zz"), (1, 0, "assistant", "</s>"), (1, 0, "<s>", "m")]
    got = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows)).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256(b"</s>zz").hexdigest()


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "␛0␛1␛", "[INST]", "a[/INST", "]", "<s>", "", None, "[OUT]x\ny\n", "plain\n", "␛", "<", "/s>", "y" * 20_000]
    roles = ["user", "assistant", None, "sys\ntem", "[INST]", "", "a␛9"]
    rows = [(k % 9 if k % 9 else None, k // 4, roles[k % len(roles)], hard[k * 5 % len(hard)], "clash") for k in range(120)]
    df = spark.createDataFrame([*rows, rows[7]], "conv_id long, turn long, role string, text string, formatted string")
    own = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(own).collect()}
    spans = {r.conv_id: r for r in own.collect()}
    by = defaultdict(list)
    for c, turn, role, text, _ in [*rows, rows[7]]:
        by[c].append((turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        answers = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(answers.encode()).hexdigest() and got[c].loss_chars == len(answers)
        assert got[c].formatted_chars == len(spans[c].formatted)
        raw = spans[c].formatted.encode()
        assert ["".join(spans[c].formatted[s.start : s.end]) for s in spans[c].loss_spans] == [raw[s.start : s.end].decode() for s in spans[c].loss_bytes]
    assert chat_format.read_back(chat_format.format_conversations(df.where("false"))).count() == 0


@pytest.mark.parametrize("shards", [3, 16])
def test_reshard_is_level_and_gapless(spark, docs, empty, shards):
    rows = [(i, prose(i, 20 + i * 7 % 300), f"s{min(i % 7, 3)}") for i in range(900)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for df in (many, docs):
        out = sharding.reshard(df, F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(5)), shards).collect()
        assert len(out) == df.count()
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        assert set(by) <= set(range(shards)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
        if df is many:
            size = [sum(r.size for r in by[j]) for j in range(shards)]
            assert max(size) - min(size) <= 2 * max(r.size for r in out)
            total = defaultdict(int)
            for r in out:
                total[r.old_shard] += r.size
            least = sum(max(0, n - (sum(total.values()) // shards) * (old < shards)) for old, n in total.items())
            assert sum(r.size for r in out if r.shard != r.old_shard) < 1.05 * least + 4000
    assert {r.size for r in out if r.doc_id in (0, 1)} == {1}
    assert sharding.reshard(empty, F.lit(0), shards).count() == 0
    assert sharding.reshard(many, F.lit(None), shards).count() == 900


@pytest.mark.parametrize("shards", [1, 3])
def test_rewrite_writes_each_row_once(spark, tmp_path, shards):
    """Null and repeated keys, shards that end up empty, and shards that stay."""
    rows = [(None if i % 40 == 7 else i // 2 if i < 30 else i, f"text {i // 3} " + "w" * (i % 50), "en", i % 2 if i < 80 else 0 if i < 118 else 5, 1) for i in range(120)]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, lang string, old int, slot int")
    path = str(tmp_path / "out")
    df.drop("slot").withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(path)
    done = sharding.rewrite(df, F.col("old"), path, shards)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.lang, r.old) for r in back.collect()) == Counter((r.doc_id, r.text, r.lang, r.old) for r in df.collect())
    assert {r.shard for r in back.select("shard").distinct().collect()} <= set(range(shards)) and 5 in done
    for shard in set(done) & set(range(shards)):
        assert sorted(r.slot for r in back.where(F.col("shard") == shard).collect()) == list(range(back.where(F.col("shard") == shard).count()))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_reshard_moves_little_more_than_the_least(spark, sf):
    """The least for exactly level shards; giants, which can't be cut, may move more or leave shards less level."""
    out = QUERIES["op2_reshard"](spark, f"/root/testdata/{sf}").collect()
    before, after = Counter(), Counter()
    for r in out:
        before[r.old_shard] += r.size
        after[r.shard] += r.size
    share, most = sum(before.values()) / 16, max(r.size for r in out)
    least = sum(max(0, n - share * (old < 16)) for old, n in before.items())
    moved = sum(r.size for r in out if r.shard != r.old_shard)
    print(sf, moved / least, max(after.values()) / share, min(after[k] for k in range(16)) / share)
    assert moved < 1.03 * least and max(after.values()) < share + most and min(after[k] for k in range(16)) > share - most


def test_classifier_on_held_out_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    s = quality.Settings(buckets=64, dims=4, ones=2)
    assert {r.score for r in quality.score(docs, quality.fit(docs, none, s), s).collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, none, s), s).count() == 0


def jaccard(a: str, b: str) -> float:
    of = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(max(1, len(w) - 4))}
    return len(of(a) & of(b)) / len(of(a) | of(b))


def classes_of(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def near_classes(rows):
    """Class of each row (doc_id, text) by all pairs: smallest doc_id of the class, and the rows of each class."""
    own = list(range(len(rows)))
    worded = [i for i in own if rows[i][1] and WORD.search(rows[i][1])]
    pairs = [(a, b) for a, b in combinations(worded, 2) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    classes = classes_of(pairs, own)
    least = {}
    for i in own:
        if rows[i][0] is not None:
            least[classes[i]] = min(least.get(classes[i], rows[i][0]), rows[i][0])
    return Counter((rows[i][0], least.get(classes[i])) for i in own), classes


def test_near_duplicates_equal_all_pairs(spark, sf, docs, empty):
    twice = [(3, prose(50, 40)), (5, prose(51, 40)), (5, prose(50, 40)), (7, prose(51, 40)), (7, prose(51, 40)), (None, prose(51, 40)), (None, prose(52, 40)), (9, None), (9, ""), (None, " ")]
    names = spark.createDataFrame([(f"d{i}", t) for i, t in twice], "doc_id string, text string")
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), docs, spark.createDataFrame(twice, "doc_id long, text string"), names):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = neardup.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.class_id) for r in out) == near_classes(rows)[0]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_recall_over_a_table(spark):
    """All pairs of a larger table by an index of shingles."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, holders = {}, defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            for x in sets[i]:
                holders[x].append(i)
    shared = Counter(p for own in holders.values() for p in combinations(own, 2))
    true = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(true) > 90 and got == classes_of(true, got)


def heavy_pairs(n):
    """Pairs of texts of set similarity over 0.8 that differ in a block of 44 words repeated 20 times."""
    own = lambda name, m: " ".join(f"{name}{i}" for i in range(m))
    texts = [own(f"k{k}w", 424) + " " + " ".join([own(f"k{k}{side}x", 44)] * 20) for k in range(n) for side in "ab"]
    assert all(0.8 <= jaccard(texts[i], texts[i + 1]) < 0.83 for i in range(0, len(texts), 2))
    return texts


def test_repeated_blocks_keep_pairs_as_candidates(spark):
    rows = list(enumerate(heavy_pairs(40)))
    bands = {r.doc_id: set(r.bands) for r in neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(bands[i] & bands[i + 1] for i in range(0, 80, 2))


def test_blocks_keep_pairs_that_differ_in_repeated_blocks(spark):
    rows = list(enumerate(heavy_pairs(8)))
    contents = spark.createDataFrame(rows, "id long, text string")
    members = spark.createDataFrame([(7, i, 468) for i, _ in rows], "key long, id long, size long")
    _, found = links.near_links(members, lambda ids: neardup.shingle_sets(contents.join(ids, "id")))
    assert {r.id: r.component for r in found.collect()} == {i: i - i % 2 for i in range(16)}


def test_repeated_tails_are_joined(spark):
    """One side's own last words come 300 times; the sets stay similar."""
    own = lambda name, m: " ".join(f"{name}{i}" for i in range(m))
    rows = []
    for k in range(60):
        same = own(f"t{k}w", 180)
        rows += [(2 * k, same + " " + own(f"t{k}a", 17)), (2 * k + 1, same + " " + " ".join([own(f"t{k}b", 17)] * 300))]
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.8 for i in range(0, 120, 2))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_search_links_are_named_so(spark):
    """Twelve near copies in large keys are all linked with each other, which the search doesn't count."""
    words = prose(31, 200).split()
    rows = [(i, " ".join([*words[: 10 * i], f"edit{i}", *words[10 * i + 1 :]])) for i in range(12)] + [(50, prose(32, 200)), (51, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.columns[:3] == ["doc_id", "class_id", "n_search_links"]
    got = {r.doc_id: (r.class_id, r.n_search_links > 0) for r in out.collect()}
    assert got == {i: (0, True) if i < 12 else (i, False) for i, _ in rows}


def test_large_keys_lose_no_link(spark, monkeypatch):
    """Sixty ids in one key: a hub with its copies, a chain, pairs that only each other reach, and strangers; in many
    blocks, and with ids that are numbers, names and bytes."""
    import numpy as np

    monkeypatch.setattr(links, "BLOCK_SHINGLES", 700)
    near = {(0, k) for k in range(1, 20)} | {(k, k + 1) for k in range(20, 30)} | {(40, 41), (42, 43), (44, 45), (50, 59)}
    group = {0: 0, **dict.fromkeys(range(1, 20), 0), 40: 40, 41: 40, 42: 42, 43: 42, 44: 44, 45: 44, 50: 50, 59: 50}

    def numbers(i):  # a set of 100 numbers, of which linked ids share 90 or more
        return np.arange(20_000, 20_100) + 5 * (i - 20) if 20 <= i <= 30 else np.arange(100) + 1000 * group.get(i, i)

    for kind, name in (("long", int), ("string", "i{:02}".format), ("binary", lambda i: bytes([200, i]))):
        sets = spark.createDataFrame([(name(i), numbers(i).astype(np.uint64).tobytes()) for i in range(60)], f"id {kind}, shingles binary")
        rows = [(7, i) for i in range(60)] + [(8, i) for i in range(0, 60, 2)] + [(9, 40), (9, 41)]
        members = spark.createDataFrame([(k, name(i), 100) for k, i in rows], f"key long, id {kind}, size long")
        own, found = links.near_links(members, lambda ids: sets.join(ids, "id"))  # noqa: B023
        got = {r.id: r.component for r in found.collect()}
        assert {i: got.get(name(i), name(i)) for i in range(60)} == {i: name(c) for i, c in classes_of(near, range(60)).items()}
        assert own.count() < 250  # not all pairs of the large keys


def test_block_forest_joins_what_all_pairs_join():
    import numpy as np

    draw = np.random.default_rng(4)
    for _ in range(30):
        base = [np.unique(draw.integers(0, 10**9, 60)) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[: 60 - int(k)], draw.integers(0, 10**9, int(k))])) for b in base for k in draw.integers(0, 12, 6)]
        sets = [s.astype(np.uint64) for s in sets]
        alike = lambda p, q: len(np.intersect1d(p, q)) / len(np.union1d(p, q)) >= 0.8
        xs, ys = np.arange(0, 18, 2), np.arange(18)
        want = classes_of([(i, j) for i in xs for j in ys if i != j and alike(sets[i], sets[j])], range(18))
        out = links.forest(list(range(18)), sets, xs, ys, 0.8)
        assert all(alike(sets[a], sets[b]) for a, b, _ in out) and len(out) == 18 - len(set(want.values()))
        assert classes_of([(a, b) for a, b, _ in out], range(18)) == want


def test_passages_against_planted(spark, docs, empty, texts):
    out = passages.repeated_passages(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert {11, 12, 4, 5, 6, 7, 14} <= set(by) and not set(by) & {0, 1, 2, 3, 8, 9, 10, 13}
    for i in (11, 12):
        covered = sum(r.end - r.start for r in by[i])
        assert covered > 0.6 * len(prose(4, 60))
    assert not by[11][0].removed and by[12][0].removed
    assert passages.repeated_passages(empty).count() == 0


def test_passages_anywhere_in_their_hosts(spark):
    """Passages of 51 to 60 words in the middle of sentences, of short lines, and without sentence ends; the limits are
    exact to the word, as no host has words of another one."""
    own = lambda seed, n: " ".join(f"w{seed}q{i}" for i in range(n))
    middle = ". ".join(" ".join(WORDS[zlib.crc32(f"m{k}:{i}".encode()) % 60] for i in range(17)) for k in range(3))
    lines = "\n".join(" ".join(WORDS[zlib.crc32(f"l{k}:{i}".encode()) % 60] for i in range(2 + k % 4)) for k in range(16))
    plain = " ".join(WORDS[zlib.crc32(f"p{i}".encode()) % 60] for i in range(52))
    same = " ".join(["again"] * 55)
    rows, planted = [], []
    for k, (passage, around) in enumerate([(middle, 9), (lines, 30), (plain, 5), (same, 12)]):
        assert 51 <= len(passage.split()) <= 60
        for host in range(3):
            before = own(f"{k}a{host}", around - host) + " "
            planted.append((len(rows), len(before), len(before) + len(passage), host > 0 or passage is same))  # "again" also repeats inside its host
            rows.append((len(rows), before + passage + " " + own(f"{k}b{host}", around + 8 * host)))
    rows += [(100 + k, own(f"lone{k}", 80)) for k in range(3)] + [(200, None), (201, "")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.end, r.removed) for r in got] == planted
    assert [r.n_words for r in got] == [len(rows[i][1][a:b].split()) for i, a, b, _ in planted]


def test_equal_runs_hold_every_shared_run(spark):
    """Each run of 24 words that two documents share is inside an equal run, and each end of one is the end of a shared run."""
    texts = {}
    for d in range(24):
        parts = [prose(900 + zlib.crc32(f"{d}:{j}".encode()) % 9, 40 + d)[(d * j * 7) % 50 :] if j % 2 else prose(5000 + 10 * d + j, 30) for j in range(5)]
        texts[d] = " ".join(parts)
    words = {d: [m.span() for m in WORD.finditer(t)] for d, t in texts.items()}
    runs = lambda n: {d: [tuple(texts[d][a:b] for a, b in w[i : i + n]) for i in range(len(w) - n + 1)] for d, w in words.items()}
    covered = defaultdict(set)
    for r in passages.equal_runs(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))).collect():
        covered[r.doc_id] |= set(range(r.first_word, r.last_word))
    for n, holds in ((24, lambda want, d: want <= covered[d]), (passages.PRINT, lambda want, d: covered[d] <= want)):
        held = defaultdict(set)
        for d, own in runs(n).items():
            for x in own:
                held[x].add(d)
        for d, own in runs(n).items():
            want = {i + k for i, x in enumerate(own) if len(held[x]) > 1 for k in range(n)}
            assert holds(want, d)
            assert want or n != 24


def test_near_paragraphs_equal_all_pairs(spark, docs, empty):
    """Lines of 24 words or more whose class, by all pairs of distinct ones, spans two documents."""
    lines = {}
    for d in range(40):
        own = []
        for j in range(3):
            words = prose(700 + (d + 3 * j) % 14, 30 + (d + 3 * j) % 14 * 4).replace(".", "").split()
            for k in range(d % 3):
                words[(d * 7 + j * 5 + k * 11) % len(words)] = f"edit{d}x{j}x{k}"
            own.append(" ".join(words))
        lines[d] = [*own, "a short line", prose(3000 + d, 24 - d % 2).replace(".", "")]
    rows = [(d, "\n".join(own)) for d, own in lines.items()]
    rows += [rows[0], (3, prose(703, 60)), (90, None), (91, "")]
    each = [(d, first, " ".join(WORD.findall(line.lower()))) for d, t in dict.fromkeys(rows) for first, line in lines_of(t)]
    long = [x for x in each if len(x[2].split()) >= 24]
    distinct = sorted({x[2] for x in long})
    pairs = [(a, b) for a, b in combinations(range(len(distinct)), 2) if jaccard(distinct[a], distinct[b]) >= 0.8]
    assert len(pairs) > 20
    classes = classes_of(pairs, range(len(distinct)))
    holders, place = defaultdict(set), {t: k for k, t in enumerate(distinct)}
    for d, _, t in long:
        holders[classes[place[t]]].add(d)
    want = Counter((d, first, first + len(t.split())) for d, first, t in long if len(holders[classes[place[t]]]) > 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.xxhash64("text")).where("text IS NOT NULL")
    out = passages.near_paragraphs(df).collect()
    assert Counter((r.doc_id, r.first_word, r.last_word) for r in out) == want
    assert len({r.class_id for r in out if not r.removed}) == len({r.class_id for r in out}) == sum(not r.removed for r in out)


def lines_of(text):
    """First word and text of each line."""
    at = 0
    for line in (text or "").split("\n"):
        yield at, line
        at += len(WORD.findall(line))


def windows_of(t, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return w, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_contamination_against_brute_force(spark, docs, empty, texts):
    items = [(1, prose(4, 30)), (2, "Short Text"), (3, None), (4, ""), (10, " ".join(texts[8].split()[40:55])), (11, prose(77, 40)), (12, "a a"), (13, texts[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    mixed = " ".join(sorted(prose(77, 40).split()[3:15])) + " and so on " + prose(4, 12)
    for df in (docs, spark.createDataFrame([(5, "a a a b a a", 1), (6, prose(4, 12) + " " + prose(4, 30), 2), (7, mixed, 3)], "doc_id long, text string, pos int")):
        got = decontaminate.contamination(df, bench, within=30).collect()
        assert len(got) == df.count()
        rows = {r.doc_id: r.text for r in df.collect()}
        seen = Counter(w for r in df.collect() for w in windows_of(r.text)[0])
        for r in got:
            words, _ = windows_of(rows[r.doc_id])
            hit, names, near = set(), set(), set()
            for item, text in items:
                for win in windows_of(text)[1]:
                    rarest = min(win, key=lambda w: (seen[w], win.index(w)))
                    if any(w == rarest and set(win) <= set(words[max(i - 30, 0) : i + 31]) for i, w in enumerate(words)):
                        near.add(item)
                    for i in range(len(words) - len(win) + 1):
                        if tuple(words[i : i + len(win)]) == win:
                            hit |= set(range(i, i + len(win)))
                            names.add(str(item))
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(names), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert r.n_near_items == len(near)
    assert {(r.doc_id, r.n_items, r.n_near_items) for r in got} >= {(7, 1, 2)}  # one item only by proximity
    assert decontaminate.contamination(empty, bench, within=30).count() == 0
    assert "n_near_items" not in decontaminate.contamination(empty, bench).columns
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    near = decontaminate.proximity_matches(docs, spark.createDataFrame([(1, "text short")], "item_id long, text string")).collect()
    assert {r.doc_id for r in near} == {3}


def test_pipeline_stages(spark, sf):
    """Each stage against code that isn't the operator, on the documents with rows of every odd kind added."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*p.COLUMNS)
    taken = docs.where("doc_id IN (3, 4)").collect()
    odd = [(None, None, None, None, None), (None, taken[0].text, "en", "s", 1), (9001, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "one two", "en", "s", 7), (9002, "one two", "en", "s", 7), (9002, "one two", "de", "s", 7), (taken[0].doc_id, prose(60, 50), "en", "s", 9), (9003, prose(61, 30_000), "en", "s", 1), (9004, "x" * 100_000, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame([*odd, tuple(taken[1])], docs.schema)).withColumns({"score": F.lit(1), "text_key": F.lit(2), "class_id": F.lit(3), "ids": F.lit(4), "_text": F.lit("x")})
    rows = [tuple(r)[:5] for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(p.STAGES)
    kept = stages["quality classifier"](spark, docs, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert sum(labels[i] == (i in ids) for i in labels) / len(labels) > 0.9
    assert not Counter(map(tuple, kept.collect())) - Counter(rows)
    once = stages["near-duplicates"](spark, docs, sf)
    _, classes = near_classes(rows)
    group = [("w", classes[i]) if rows[i][1] and WORD.search(rows[i][1]) else ("n", rows[i][0]) for i in range(len(rows))]
    out = [tuple(r) for r in once.collect()]
    assert len(out) == len(set(group)) and not Counter(out) - Counter(rows)
    own = defaultdict(list)
    for i, g in enumerate(group):
        own[g].append(rows[i])
    for g in own.values():
        (stays,) = [r for r in dict.fromkeys(g) if r in out]
        assert stays[0] == min((r[0] for r in g if r[0] is not None), default=None)
    clean = stages["decontamination"](spark, docs, sf)
    items = [windows_of(r.text)[1] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = lambda t: any(tuple(w[i : i + len(x)]) == x for w in [windows_of(t)[0]] for i in range(len(w)) for x in starts.get(w[i], ()))
    starts = defaultdict(set)
    for item in items:
        for x in item:
            starts[x[0]].add(x)
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not bad(r[1]))
    redacted = stages["personal data"](spark, docs, sf)
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert not any(re.search(email, r.text or "") for r in redacted.collect()) and redacted.count() == len(rows)
    cue = r"[@+0-9]|(?i:account|acct|iban|ssn|passport|licen|tax|customer|passw|pwd|token|secret|api|akia|asia)"
    assert not Counter(r[:2] for r in rows if not re.search(cue, r[1] or "")) - Counter((r.doc_id, r.text) for r in redacted.collect())
    for df in (kept, once, clean, redacted):
        assert df.columns == p.COLUMNS
    last = stages["byte-level BPE"](spark, docs, sf)
    import tiktoken

    peer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.encoder(RANKS, PATTERN).ranks, special_tokens={})
    want = Counter((i, tuple(peer.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == want and last.where("NOT round_trip").count() == 0
    for name, stage in p.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def test_pipeline_run(spark, sf):
    import corpus_pipeline as p

    out = p.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count() and out.where("NOT round_trip").count() == 0


def test_held_out_rule(spark):
    assert {r.doc_id for r in spark.range(200).withColumnRenamed("id", "doc_id").where(held_out()).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
