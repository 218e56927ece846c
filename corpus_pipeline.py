"""Corpus pipeline: documents through five operators, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, works
on all its predecessor kept and returns a DataFrame; all but the last return the
columns of documents.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmsift.llm import decontaminate, minhash_forest, packing, queries, secret_scan, toxicity
from swarmsift.llm.common import cut_lineage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    An id goes if none of its rows stays.  Rows that repeat an id and its text are one document;
    rows of one id with different texts all stay with their id, as do rows without an id."""
    found = minhash_forest.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    ids = found.groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("rows")).filter("doc_id is not null")
    ids = cut_lineage(ids.filter("not stays or rows > 1"), "near_duplicate_ids")
    rest = docs.select(*COLUMNS).join(ids.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.select(*COLUMNS).join(ids.filter("stays").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)
    return rest.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark; no document goes."""
    found = secret_scan.scan(docs, carry=COLUMNS)
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source",
                        F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, tokenized and packed into sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("packing", pack)]
#: A trained network, MinHash and a tokenizer: no stage but the fourth is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
