"""A corpus pipeline from five operators; each stage reads what the one before it wrote.

quality classifier -> near-duplicates -> benchmark decontamination -> personal data -> byte-level BPE
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import bpe, decontaminate, neardup, pii, quality
from panelmill.llm.common import cut_lineage, table
from panelmill.llm.queries import PATTERN, RANKS, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose doc_id and text (by its 64-bit hash, text_key) aren't removed."""
    removed = cut_lineage(removed.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct())
    return docs.join(removed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_key")), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3 go; it learns from labelled rows outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).where(F.col("score") >= 0.3).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class stays (null last, then the smallest text hash; of rows that repeat
    both the one with the smallest other columns); rows of one doc_id without words are a class."""
    docs = docs.select(*COLUMNS)
    found = neardup.near_duplicates(docs).groupBy("doc_id", "text_key").agg(F.first("class_key").alias("class_key"), F.count(F.lit(1)).alias("n"))
    found = cut_lineage(found.withColumn("own", F.when(F.isnull("class_key"), F.struct("doc_id"))))
    best = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "text_key")).alias("best")
    stay = cut_lineage(found.groupBy("class_key", "own").agg(best, F.sum("n").alias("rows")).where("rows > 1").select("class_key", "own", "best"))
    others = found.join(stay, found["class_key"].eqNullSafe(stay["class_key"]) & found["own"].eqNullSafe(stay["own"]), "left_semi")
    kept = stay.select("best.doc_id", "best.text_key")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    left = without(docs, others.join(kept, same(others, kept), "left_anti"))
    again = cut_lineage(found.where("n > 1").join(kept, same(found, kept), "left_semi").select("doc_id", "text_key"))
    if again.isEmpty():
        return left
    marked = left.withColumn("text_key", F.xxhash64("text"))
    once = marked.join(again, same(marked, again), "left_semi").groupBy("doc_id", "text_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return without(left, again).unionByName(once.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = docs.select(*COLUMNS)
    return without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kinds in brackets; n_chars follows."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to the text."""
    encoded = bpe.encode_documents(docs.select(*COLUMNS), RANKS, PATTERN, round_trip=True)
    return encoded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("byte-level BPE", encode_bytes),
]

#: SQL can't express the classifier, signatures or merges; see the tests of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
