"""Classification metrics from ONE confusion table.

Spark's MulticlassClassificationEvaluator semantics: classes are the true
labels; precision of a class with no predictions is 0; "f1" is the
support-weighted F1.  Macro F1 and a majority-class baseline are reported
next to it because weighted F1 is blind on imbalanced data.

All functions accept ``by`` (e.g. a candidate id) so a whole population is
evaluated in one aggregation.  The confusion table has at most
groups × classes² rows, so everything after it is tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list | None = None) -> DataFrame:
    by = list(by or [])
    return (pred.groupBy(*by, F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("count")))


def metrics_from_confusion(conf: DataFrame, by: list | None = None) -> DataFrame:
    by = list(by or [])
    actual = conf.groupBy(*by, F.col("label").alias("cls")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(*by, F.col("prediction").alias("cls")).agg(F.sum("count").alias("npred"))
    per = actual.join(predicted, by + ["cls"], "left").fillna(0, subset=["npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    tot = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("weightedPrecision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("weightedRecall"),
        F.avg("f1").alias("macro_f1"),
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: list | None = None) -> DataFrame:
    return metrics_from_confusion(confusion_matrix(pred, label, prediction, by), by)


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Metrics of predicting the most frequent train label (ties: lowest)."""
    top = (train.groupBy(F.col(label).alias("__maj")).agg(F.count(F.lit(1)).alias("__n"))
           .orderBy(F.desc("__n"), F.asc("__maj")).first())  # one row
    pred = test.withColumn("prediction", F.lit(top["__maj"]).cast("double"))
    return classification_metrics(pred, label, "prediction")
