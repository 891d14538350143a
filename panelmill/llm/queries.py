"""One query for each operator, with production parameters, over its whole table; and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, merkle, neardup, passages, phrases, pii, quality, repetition, sharding, suffixes, token_attribution
from .common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], own.schema)
    return chat_format.read_back(chat_format.format_conversations(own.unionByName(extra)))


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout: 12 shards by a hash of the source, which are uneven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(12))
    placed = sharding.reshard(docs, old, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.section_tokens(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score_repetition(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score(docs, model).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=30).drop("text_key")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.is_tampered()).drop("path")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_reshard, op3_token_counts, op4_byte_bpe, op5_pii, op6_quality_rules, op7_quality_classifier, op8_near_duplicates, op9_decontaminate, op10_repeated_passages, op11_collocations, op12_merkle_manifest, op13_suffix_dedup)}

ORACLES: dict[str, str] = {}
ORACLES["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, role = 'assistant' AS loss,
    contains(text, '<s>') OR contains(text, '[INST]') OR contains(text, '[/INST]') OR contains(text, '[OUT]') OR contains(text, '</s>') OR contains(text, chr(9243)) AS clash,
    length(replace(replace(replace(replace(replace(replace(text, chr(9243), '..'), '<s>', '..'), '[INST]', '..'), '[/INST]', '..'), '[OUT]', '..'), '</s>', '..')) AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  (3 + sum(CASE WHEN loss THEN 9 ELSE 13 END + length(role) + 1 + CASE WHEN clash THEN escaped ELSE length(text) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
ORACLES["op9_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, list_slice(ws, s, s + 9) AS win FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT len(win) AS n FROM w),
p AS (
  SELECT rid, s, n, list_slice(ws, s, s + n - 1) AS win FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS s) WHERE len(ws) >= n
), m AS (SELECT rid, s, n, item_id FROM p JOIN w USING (win)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(s, s + n - 1)) AS q) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid),
t AS (SELECT rid, pos, ws[pos] AS term, ws FROM d, LATERAL (SELECT unnest(generate_series(1, len(ws))) AS pos)),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
r AS (
  SELECT item_id, win, arg_min(win[o], (coalesce(df, 0), o)) AS term
  FROM w, LATERAL (SELECT unnest(generate_series(1, len(win))) AS o) LEFT JOIN f ON f.term = win[o] GROUP BY item_id, win
), g AS (
  SELECT rid, count(DISTINCT item_id) AS n_near_items FROM t JOIN r USING (term)
  WHERE list_has_all(list_slice(ws, greatest(pos - 30, 1), pos + 30), win) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN g USING (rid)
"""

ORACLES["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS phrase, count(*) AS a FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k), LATERAL (SELECT unnest(generate_series(1, len(ws) - k + 1)) AS s) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT c.*, i, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM c) c JOIN t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.k = i AND x.phrase = array_to_string(list_slice(ws, 1, i), ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = array_to_string(list_slice(ws, i + 1, c.k), ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.lang = b.lang AND z.k > b.k AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""


def _climb_sql(name: str, source: str, levels: int) -> str:
    """Levels 0 to `levels` of trees by eight: g, i (place in the level), h and n (nodes of the level), and what stands to
    the left and right of a node among its siblings."""
    sides = "coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs"
    parts = [f"{name}0 AS (SELECT *, {sides} FROM ({source}))"]
    for k in range(1, levels + 1):
        up = f"SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY g, i // 8, n"
        parts.append(f"{name}{k} AS (SELECT *, {sides} FROM ({up}))")
    return ", ".join(parts)


def _fold_sql(name: str, source: str, levels: int) -> str:
    """f and p of the source (the hash so far, the siblings so far) carried up the levels of g from place i."""
    out = source
    for k in range(levels):
        known = "s.* EXCLUDE (n, lhs, rhs)" if k else "s.*"
        step = f"SELECT {known}, t.n, t.lhs, t.rhs FROM ({out}) s JOIN {name}{k} t ON s.g = t.g AND s.i = t.i"
        out = f"SELECT * REPLACE (CASE WHEN n > 1 THEN sha256(lhs || f || rhs) ELSE f END AS f, CASE WHEN n > 1 THEN p || lhs || rhs ELSE p END AS p, i // 8 AS i) FROM ({step})"
    return f"SELECT * EXCLUDE (n, lhs, rhs) FROM ({out})"




def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of short strings by its bits, as DuckDB has no function for it: remainders of the reflected polynomial.
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384)))"
ORACLES["op12_merkle_manifest"] = f"""
WITH d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS h,
    CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS seen FROM documents),
e AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_climb_sql("a", "SELECT g, i, n, h FROM e", 8)},
{_climb_sql("b", "SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM a8", 4)},
x AS ({_fold_sql("a", "SELECT doc_id, h AS leaf, seen, g, i, seen AS f, '' AS p FROM e", 8)}),
y AS ({_fold_sql("b", "SELECT doc_id, leaf, a8.h AS subroot, 0 AS g, x.g AS i, f, p FROM x JOIN a8 ON x.g = a8.g", 4)})
SELECT doc_id, leaf, subroot, b4.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b4.h AS verified FROM y, b4
"""
