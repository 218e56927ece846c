"""The thin opN queries: read the tables, apply the operator, derive the digest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, embed_dedup, html_blocks, minhash_forest, packing, quality, secret_scan, suffix_dedup, toxicity, vantage, whitening
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the scorer that the weak-label model trains."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    weights, _, _ = quality.fit(docs)
    return quality.score(docs, np.zeros((1 << quality.BITS) + 1) if weights is None else weights)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; strings of 50 bytes that a smaller document has are removed."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of equal label with cosine of 0.98 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash_forest.near_duplicates(docs, width=4, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a network fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every benchmark item that a document holds, edits up to a fifth of its words included."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumn("contaminated", F.lit(True))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, plus conversation -1, through the schema-fingerprint formatter."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    records = rows.unionByName(extra).select(
        "conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("payload"))
    return chat.digest(chat.format_turns(chat.canonical_turns(records), "conv_id", ["turn"]), "conv_id")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; the labeller is fitted on a bounded sample of the same pages."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; owner = source, repository = document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return secret_scan.digest(secret_scan.scan(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: every source of a language against its other sources and against the language."""
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50, among all rows."""
    return vantage.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whitened on the 16 strongest components of the distinct grid vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_html_extract": op6_html_extract,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_whitening": op13_whitening,
}
