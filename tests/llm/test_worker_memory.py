import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from swarmsift.llm import common, decontaminate, minhash_forest, packing, queries, toxicity


def own_mb() -> float:
    text = Path("/proc/self/smaps_rollup").read_text()
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", text))) / 1024


def test_workers_rest_small_after_all_stages(spark):
    """Spark uses its Python workers again, so what one stage leaves in them counts in the next."""
    def report(it):
        for pdf in it:
            yield pd.DataFrame({"mb": [own_mb()] * len(pdf), "words": [len(decontaminate.WORDS)] * len(pdf)})

    digits = F.transform(F.sequence(F.lit(1), F.lit(250)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(400_000)).cast("string"))
    docs = spark.range(0, 16_000, 1, 2).select(F.col("id").alias("doc_id"),
                                               F.translate(F.concat_ws(" ", digits), "0123456789", "abcdefghij").alias("text"))
    items = spark.createDataFrame([(1, "a passage that no document of these holds anywhere at all")], "item_id long, text string")
    model = toxicity.init() | {"pool": np.array([0, 1, 0, 0, 0], np.float64)}
    for out in (packing.tokenized_pieces(docs, queries.tokenizer_path()), toxicity.keep_clean(docs, model),
                minhash_forest.features(docs, 5, "text", "doc_id"), decontaminate.keep_clean(docs, items)):
        out.write.format("noop").mode("overwrite").save()
    got = spark.range(0, 32, 1, 32).mapInPandas(report, "mb double, words long").agg(F.max("mb"), F.max("words")).first()
    assert got[0] < 250 and got[1] == 0


def test_tidy_runs_the_whole_partition():
    ended = []
    batches = [pa.record_batch({"x": list(range(i))}) for i in (3, 0, 5)]
    run = common.tidy(lambda it: (b.num_rows for b in it), lambda: ended.append(1))
    assert list(run(iter(batches))) == [3, 0, 5] and ended == [1]
    assert list(run(iter([]))) == [] and ended == [1, 1]
