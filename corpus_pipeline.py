"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each one's rows as Parquet
and rereads them for the next. All but the last return the columns of ``documents``, and extra ones of any name.
An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import contamination, minhash_dedup, packing, suffix_dedup, toxicity
from strandline.llm.work import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Null and empty texts and null ids stay; of repeated rows each is judged."""
    chain = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")  # names that clash with the scores'
    scored = toxicity.score(docs.select(rest, "text"), chain).where("not rejected")
    return scored.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8), the smallest id stays, with all rows that repeat it. Texts without words and null ids stay."""
    return minhash_dedup.dedup(docs, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 200 bytes or more are cut; the first stays, as do all rows. Null texts stay null."""
    return suffix_dedup.remove(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is nothing else goes. Null and empty texts stay."""
    return contamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows of 1024 tokens; a null or empty text is its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", cut_benchmark), ("packing", pack)]

#: The stages use trained models, sketches and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
