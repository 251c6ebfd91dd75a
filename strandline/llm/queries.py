"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import contamination, embedding_dedup, html_extract, minhash_dedup, packing, quality, suffix_dedup, token_counts, toxicity, url_filter
from strandline.llm.work import Scratch

TOKENIZER = "byte_bpe_50k.json"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination.find(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["word_to"] - s["word_from"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"), 0.98)


def _token_counts(spark: SparkSession, sf_dir: str, tokenizers: dict[str, str | None]) -> DataFrame:
    """The totals of all documents, after a load of drafts, a revision of each row, and a delete and new insert of a part.

    The load is committed twice; the second time changes nothing. The deltas are folded before the last batch.
    """
    docs = _table(spark, sf_dir, "documents").select("source", "lang", "text")
    half = F.expr("substring(text, 1, length(text) div 2)")
    drafts = docs.withColumn("text", half)
    change = docs.select("source", "lang", "text", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), half.alias("old_text"))
    part = docs.where(F.crc32("text") % 4 == 0)
    ledger = token_counts.TokenLedger(spark, Scratch(spark, "tokens").root, tokenizers)
    ledger.commit("load", token_counts.signed(inserts=drafts))
    ledger.commit("load", token_counts.signed(inserts=drafts))
    ledger.commit("revise", token_counts.signed(revised=change))
    ledger.commit("delete", token_counts.signed(deletes=part))
    ledger.compact()
    ledger.commit("insert", token_counts.signed(inserts=part))
    return ledger.rollup()


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(spark, sf_dir, {"words": None, TOKENIZER.split(".")[0]: public_tokenizers.path(TOKENIZER)})


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op3_token_counts``, for the tokenizer that SQL can express."""
    return _token_counts(spark, sf_dir, {"words": None})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranker = quality.train(docs.where(~held_out), _table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), ranker).select("doc_id", "held_out", "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_table(spark, sf_dir, "documents"), 85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text").withColumn("toxic", F.col("rejected").cast("int"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("ids")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_embedding_dedup, op3_token_counts, op4_suffix_dedup, op5_quality, op6_url_filter, op7_html_extraction, op8_minhash_dedup, op9_toxicity, op10_packing, word_counts, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from strandline.llm.oracles import ORACLES

    return dict(ORACLES)
