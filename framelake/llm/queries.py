"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, fim, hosts, inner, jaccard, lexical, licenses, nearest, neardup, packing, substrings, toxicity, warc
from framelake.llm.oracle import ORACLE  # noqa: F401

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(table: str, *cols: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


_docs, _pages, _vectors = _read("documents", "doc_id", "text"), _read("pages", "page_id", "url", "html"), _read("embeddings", "vec_id", "embedding")
_items = _read("benchmark", "item_id", "text")
_labels = _read("labels", "doc_id", "toxic")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_vectors(spark, sf_dir), 0.9)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_docs(spark, sf_dir), k=4, num=85, den=100)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_docs(spark, sf_dir), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 2048)


def op7_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(_pages(spark, sf_dir), RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return nearest.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), 10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scored = toxicity.score_documents(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "starts", "ends")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_docs(spark, sf_dir)), _items(spark, sf_dir), 20)


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(_docs(spark, sf_dir), seed=1, plain=10, spm=20)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return inner.top_products(rows, rows.where("vec_id % 100 = 0"), 10, 1024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_neardup, op2_licenses, op3_jaccard, op4_warc, op5_substrings, op6_packing, op7_hosts, op8_nearest, op9_bpe, op10_toxicity, op11_lexical, op12_middle, op13_inner, pipeline)}
