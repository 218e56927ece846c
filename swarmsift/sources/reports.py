"""Report sinks: selected-feature list (one name per line), run report (JSON), metrics and
importance text with 6 decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One schema for all algorithms; what an algorithm does not have is NULL and left out of its JSON.
RUN_REPORT = ("algo string, subset_size int, total_features int, selected_features array<string>, best_obj double, "
              "accuracy double, f1 double, weightedPrecision double, weightedRecall double, macro_f1 double, "
              "evaluations int, fits int, iters int, stopped_early boolean, lambda double, k_cap int, big_penalty double, "
              "elapsed_search_sec double, elapsed_finaltrain_sec double, "
              "history array<struct<iter:int,best_obj:double,best_k:int>>")
METRICS = ("accuracy", "f1", "weightedPrecision", "weightedRecall", "macro_f1")


def run_report(spark: SparkSession, res: dict, selected: list, total: int, final: dict) -> DataFrame:
    """One row from a search's result and the final retrain."""
    history = [(int(h["iter"]), float(h["best_obj"]), h.get("best_k")) if isinstance(h, dict) else (i, float(h), None)
               for i, h in enumerate(res["history"])]
    known = {c: res.get(c) for c in ("evaluations", "fits", "iters", "stopped_early", "lambda", "k_cap", "big_penalty")}
    row = {"algo": res["algo"], "subset_size": len(selected), "total_features": total, "selected_features": selected,
           "best_obj": float(res["best_obj"]), **{m: float(final["metrics"][m]) for m in METRICS}, **known,
           "elapsed_search_sec": float(res["elapsed_search_sec"]),
           "elapsed_finaltrain_sec": float(final["elapsed_finaltrain_sec"]), "history": history}
    names = [c.split()[0] for c in RUN_REPORT.split(", ")]
    return spark.createDataFrame([tuple(row[c] for c in names)], RUN_REPORT)


def nested(report: DataFrame) -> DataFrame:
    """The report as its JSON has it: metrics and search_info are objects of their own."""
    info = ("history", "elapsed_search_sec", "elapsed_finaltrain_sec", "iters", "evaluations", "fits", "stopped_early",
            "lambda", "k_cap", "big_penalty")
    return report.select("algo", "subset_size", "total_features", "selected_features", F.struct(*METRICS).alias("metrics"),
                         F.col("best_obj").alias("objective"), F.struct(*info).alias("search_info"))


def write_run_report(report: DataFrame, path: str) -> None:
    """One JSON object per run; fields that an algorithm does not have are left out."""
    nested(report).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_run_report(spark: SparkSession, path: str) -> DataFrame:
    """Reports written by :func:`write_run_report`, flat again."""
    shape = nested(spark.createDataFrame([], RUN_REPORT)).schema
    names = [c.split()[0] for c in RUN_REPORT.split(", ")]
    return spark.read.schema(shape).json(path).select(
        "*", "metrics.*", "search_info.*", F.col("objective").alias("best_obj")).select(*names)


def write_selected_features(names: DataFrame, path: str, col: str = "name") -> None:
    """One feature name per line (single small file: one row per feature)."""
    write_text(names, path, col)


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """(line): ``name: value`` with 6 decimals for every column of a one-row metrics table."""
    return metrics.select(F.posexplode(F.array(*[
        F.format_string("%s: %.6f", F.lit(c), F.col(c).cast("double")) for c in metrics.columns])).alias("at", "line")) \
        .orderBy("at").select("line")


def write_text(lines: DataFrame, path: str, col: str = "line") -> None:
    lines.select(F.col(col).alias("value")).coalesce(1).write.mode("overwrite").text(path)
