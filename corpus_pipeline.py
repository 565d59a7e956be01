"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents:

quality     documents that the quality rules reject go;
line_dedup  of a line that ten or more documents share only the first occurrence stays;
simhash     one document of each group of near copies (Jaccard 0.8 or more on five-word shingles) stays, that with
            the least doc_id: the trie self-join of fingerprints links the closest, a prefix join the rest;
mixing      sources are repeated or reduced to their target shares;
packing     token pieces get their places in sequences.

ORACLE_SQL is None: SQL has neither the shingles' hashes nor the tokenizer. The tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import encoding, line_dedup, mixing, near_copies, packing, quality
from sievework.runtime import new_folder, spread, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spread(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(spread(docs), keep_first=True)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(spread(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, encoding.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
