"""Session-level helpers: checkpoint/scratch locations and broadcast guards.

The caller owns the SparkSession.  We only read settings from it; the one
thing we may set is a checkpoint directory, and only when none is configured
and the master is local (tests, notebooks).  On a cluster a missing
``spark.checkpoint.dir`` is an error: a machine-local folder would not
survive the loss of the executor that wrote it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Broadcast only tables whose size we can bound from their shape.
DEFAULT_BROADCAST_ROWS = 2_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf:
        master = sc.master or ""
        if not master.startswith("local"):
            raise ValueError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running iterative jobs on a cluster"
            )
        conf = tempfile.mkdtemp(prefix="swarmsift-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage by writing a parquet table under the shared checkpoint
    folder and reading it back (never localCheckpoint): the result survives
    executor loss, and later scans get vectorised reads, column pruning
    and filter pushdown — which Java-serialised RDD checkpoints do not."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def brief_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, whose jobs' shuffle files go when the job has ended."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes"):
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as one partition that no job has to make."""
    names = [c.strip().split()[0].split(":")[0] for c in re.split(r",(?![^<]*>)", schema)]
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    shape = to_arrow_schema(_parse_datatype_string(schema))
    return spark.createDataFrame(pa.Table.from_pydict(columns, shape), schema).coalesce(1)


def local_rows(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table of a population's size: its rows are held by the driver."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema).coalesce(1)


class Scratch:
    """Written tables that are dropped together when their last reader is done.

    ``with Scratch(spark) as tables: df = tables.cut(df)`` — like :func:`cut_lineage`, for
    tables that no returned frame reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def maybe_broadcast(df: DataFrame, row_bound: int, limit: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven ≤ ``limit``.

    ``row_bound`` must be an upper bound derived from the table's shape
    (population size × nodes, number of features, …), never a guess.  Past
    the limit the plain DataFrame is returned and the planner shuffles.
    """
    return F.broadcast(df) if row_bound <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
