"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents:

1. quality    documents that the weak-label classifier rejects go;
2. near_dups  one document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more);
3. substrings words of repeated long spans go, the kept ones joined by one space;
4. secrets    spans of secrets become a mark;
5. packing    token pieces, ids included, with their sequence and place.

n_chars follows the text.  Rows whose doc_id is null take no part; of rows that share one, the near-duplicate
stage keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import packing, quality, secrets, simhash, substring_dedup
from matchlake.llm.common import read, scratch_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, texts: DataFrame, new: str) -> DataFrame:
    """docs (one row per doc_id) with the text replaced."""
    joined = docs.drop("text", "n_chars").join(texts.select("doc_id", F.col(new).alias("text")), "doc_id")
    return joined.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality.classify(docs, labels=read(spark, sf_dir, "labels")).where("keep").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, substring_dedup.repeated_spans(docs, texts=True), "kept")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(F.coalesce(F.col("text"), F.lit("")), F.col("found"))
    found = secrets.scan(docs.where("doc_id IS NOT NULL").select(*COLUMNS)).withColumn("text", masked)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_pieces(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dups_stage),
    ("substrings", substrings_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier. tests/llm/test_pipeline.py holds the rows of run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    top = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
