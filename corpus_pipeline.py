"""From raw documents to token ids, in five stages."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm import bpe
from lumenary.llm.decontaminate import decontaminate
from lumenary.llm.jaccard import similar_texts
from lumenary.llm.quality import quality_rules
from lumenary.llm.secret_scan import secret_scan
from lumenary.llm.storage import durable


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: the one with the smallest id, a null id last, then the least MD5 of its text."""
    found = similar_texts(docs)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("least"))
    kept = durable(first.select(F.col("least.doc_id").alias("_id"), F.col("least.mark").alias("_mark")))
    marked = docs.withColumn("_md5", F.md5("text"))
    rows = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_id"]) & marked["_md5"].eqNullSafe(kept["_mark"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_md5"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars counted anew where that changed the text."""
    found = secret_scan(docs)
    changed = F.size("spans") > 0
    new = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and a check that these decode to the text."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    make = lambda ids, decoded: (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, fields=fields, make=make)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode),
]

#: SQL has no zstandard or BPE; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; all but the last are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
