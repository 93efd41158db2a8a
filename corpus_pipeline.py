"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and all documents that the one before kept; all but the
last return the columns of documents. run() applies them to the table documents, with a
table in the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import jaccard, packing, queries, substrings, toxicity
from framelake.llm._exec import drop, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; fitted on the labelled ones outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels), 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the smallest doc_id."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out of the texts."""
    return substrings.cut_documents(docs, window=50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their place in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), 2048)


STAGES = [("toxicity", drop_toxic), ("jaccard join", drop_near_copies), ("substring dedup", drop_repeats), ("packing", pack)]
#: The stages learn, tokenise and pack, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
            if before is not None:
                drop(before)  # only the next stage read it
            before = docs
    return docs
