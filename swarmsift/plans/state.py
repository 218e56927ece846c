"""Search state on shared storage: scored masks and generations.

Both are plain parquet tables under a folder the caller names, so a search that was stopped, or
whose driver was lost, goes on after its last complete generation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as M

SCORES = "run string, key array<bigint>, score double, k int"


class ScoreTable:
    """Append-only table of scored masks, keyed by their packed bits.

    ``run`` names what a score depends on besides the mask (features, depth, evaluator, metric);
    the folder belongs to one prepared table.  A mask written twice, by a retried append, has the
    same score twice and counts once."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run
        spark.createDataFrame([], SCORES).write.mode("append").parquet(path)

    def scores(self) -> DataFrame:
        found = self.spark.read.schema(SCORES).parquet(self.path).filter(F.col("run") == self.run)
        return found.drop("run").dropDuplicates(["key"])

    def unscored(self, cands: DataFrame) -> DataFrame:
        """Distinct masks of ``cands`` that the table does not hold."""
        every = cands.select("mask", M.mask_key(F.col("mask")).alias("key")).dropDuplicates(["key"])
        return every.join(self.scores(), "key", "left_anti").select("mask")

    def append(self, scored: dict) -> None:
        """``scored``: {mask: (score, size)}, at most a population."""
        rows = self.spark.createDataFrame([(list(m), float(s), int(k)) for m, (s, k) in scored.items()],
                                          "mask array<int>, score double, k int")
        rows.select(F.lit(self.run).alias("run"), M.mask_key(F.col("mask")).alias("key"), "score", "k") \
            .coalesce(1).write.mode("append").parquet(self.path)

    def join(self, cands: DataFrame) -> DataFrame:
        """``cands`` with ``score`` and ``k``; every mask must have been scored."""
        return cands.withColumn("key", M.mask_key(F.col("mask"))).join(self.scores(), "key").drop("key")


class Generations:
    """Population and loop state of each generation; the state is written last and marks it complete.

    ``settings`` are the parameters that must not change when a search is resumed."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = json.loads(json.dumps(settings))

    def _folder(self, it: int) -> str:
        return f"{self.path}/generation-{it:06d}"

    def save(self, it: int, population: DataFrame, state: dict) -> DataFrame:
        """Writes generation ``it`` and returns its population, read back."""
        folder = self._folder(it)
        population.write.mode("overwrite").parquet(f"{folder}/population")
        text = json.dumps({"settings": self.settings, **state})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")
        return self.spark.read.parquet(f"{folder}/population")

    def latest(self, upto: int) -> tuple[int, DataFrame, dict] | None:
        """The last complete generation not after ``upto``: (number, population, state)."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation-*/state/_SUCCESS")) or []
        numbers = [int(s.getPath().getParent().getParent().getName().rsplit("-", 1)[1]) for s in done]
        numbers = [n for n in numbers if n <= upto]
        if not numbers:
            return None
        it = max(numbers)
        state = json.loads(self.spark.read.text(f"{self._folder(it)}/state").first()["value"])
        if state.pop("settings") != self.settings:
            raise ValueError(f"{self.path} holds a search with other parameters")
        return it, self.spark.read.parquet(f"{self._folder(it)}/population"), state
