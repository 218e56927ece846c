"""Model-time preparation: imputation, feature assembly, label indexing.

Done ONCE per table (the reference repeats it for every scored subset).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, finite_or_zero
from ..session import maybe_broadcast


def impute_zero(df: DataFrame, cols: list) -> DataFrame:
    """Tolerant cast to double, then NaN/±∞/NULL → 0.0, in one projection."""
    return df.withColumns({c: finite_or_zero(col(c)) for c in cols if c in df.columns})


def assemble_vector(df: DataFrame, cols: list, out: str = "features") -> DataFrame:
    """MLlib vector (VectorAssembler, handleInvalid='keep')."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def assemble_array(df: DataFrame, cols: list, out: str = "features") -> DataFrame:
    """The same features as ``array<double>`` (SQL-comparable form)."""
    return df.withColumn(out, F.array(*[col(c).cast("double") for c in cols]))


def label_index(train: DataFrame, label: str) -> DataFrame:
    """StringIndexer(frequencyDesc) as a table (label, label_idx):
    most frequent first, ties alphabetical, NULL labels not indexed.

    One aggregation; the window runs over the distinct labels only (a
    handful of rows), not over the data."""
    counts = (train.filter(col(label).isNotNull())
              .groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.orderBy(F.desc("n"), F.asc("label"))
    return counts.select("label", (F.row_number().over(w) - 1).cast("double").alias("label_idx"))


def apply_label_index(df: DataFrame, label: str, index: DataFrame, out: str = "label") -> DataFrame:
    """Join the index, broadcast if it has few labels; unseen or NULL labels →
    extra index (keep)."""
    n_labels = index.count()
    index = maybe_broadcast(index.withColumnRenamed("label", "__lab_key"), n_labels, limit=100_000)
    joined = df.join(index, col(label) == F.col("__lab_key"), "left")
    return joined.withColumn(out, F.coalesce(F.col("label_idx"), F.lit(float(n_labels)))) \
        .drop("__lab_key", "label_idx")


def to_array(df: DataFrame, vec: str = "features") -> DataFrame:
    return df.withColumn(vec, vector_to_array(F.col(vec), "float64"))
