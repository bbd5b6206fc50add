"""From raw documents to packed training sequences, in five stages that each call one operator of sparkloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes every stage's rows
as Parquet in the shared scratch folder and rereads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import compression, decontam, minhash, packing, pii
from sparkloom.llm.queries import QUALITY, THRESHOLD, table
from sparkloom.llm.textcore import materialize, pick, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. The model learns from the labelled rows of this stage's input.

    Each row is scored by its own text, so repeated rows stay or go together; null and empty texts have the score of the
    labels' shares. Without labels nothing is known and everything stays.
    """
    labels = table(spark, sf_dir, "labels")
    model = compression.fit_labelled(docs, labels, "quality", 5, 0, QUALITY)
    scored = compression.classify(docs, model, COLUMNS)
    return scored.where(F.col("score") >= THRESHOLD).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, written down so that it stays the same: doc_ids can be null or repeated."""
    return materialize(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (rows without one come last), of equal ones that of the
    least digest of its text; rows without words stay."""
    docs = _keyed(docs)
    parts = materialize(minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"))
    named = parts.join(docs.select("row", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")).alias("first"))
    gone = materialize(parts.select("row").join(materialize(first.select("first.row")), "row", "left_anti"))
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whole. Null and empty texts hold none; of repeated rows each is judged on its own."""
    docs = _keyed(docs)
    hit = materialize(decontam.contaminated(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct())
    return docs.join(hit, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each personal datum and secret replaced by its kind in angle brackets; n_chars follows the text.

    Null texts stay null; rows without spans stay as they are, repeated rows too.
    """
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null or empty text is one piece of its end mark, repeated rows all pack."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", personal_data), ("best-fit packing", pack)]

#: SQL can't express the compression classifier and the random field; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
