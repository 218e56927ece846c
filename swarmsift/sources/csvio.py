"""CSV / parquet sources and sinks.

* Multi-file CSV scan: the first line of every file is read, files with the
  same header form a group, and each group is one scan with an explicit
  all-string schema; header names trimmed, repeated header rows removed, then a
  union by column name with missing columns as NULL.  The plan has as many
  scans as there are layouts, however many files there are.
* Sinks: overwrite-mode CSV (header) and parquet.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.numeric import col
from ..operators.clean import repeated_header_filter


def list_csv_files(spark: SparkSession, folder: str) -> list:
    """Sorted, non-recursive ``*.csv`` listing through the Hadoop FS API
    (works for HDFS/S3/local alike); error when empty."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(folder)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    statuses = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.csv")) or []
    files = sorted(str(s.getPath().toString()) for s in statuses)
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return files


def _first_lines(spark: SparkSession, path: str) -> list:
    """(file, first line that is not blank) of the file, or of each data file of the folder,
    in name order; the line is None for a file without one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(conf)
    found = sorted((str(s.getPath().toString()) for s in fs.listStatus(hpath)
                    if s.isFile() and not s.getPath().getName().startswith(("_", "."))))
    out = []
    for name in found:
        file = jvm.org.apache.hadoop.fs.Path(name)
        stream = fs.open(file)
        try:
            codec = codecs.getCodec(file)
            body = stream if codec is None else codec.createInputStream(stream)
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(body, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.strip():
                line = reader.readLine()
        finally:
            stream.close()
        out.append((name, line))
    return out


def header_names(line: str) -> tuple:
    """Trimmed column names of a header line.  As in Spark's own reader a nameless column is
    ``_c`` and its position, and names that repeat (in any case) get their position appended."""
    raw = next(csv.reader([line], escapechar="\\"))
    lower = [c.lower() for c in raw]
    return tuple((f"_c{i}" if not c else f"{c}{i}" if lower.count(lower[i]) > 1 else c).strip()
                 for i, c in enumerate(raw))


def header_groups(spark: SparkSession, paths: list, readers: int = 16) -> dict:
    """{column names: files}, groups and files in the order of ``paths``.

    Only first lines are read, ``readers`` files at a time: what the driver holds is a name a
    file, as for any listing."""
    groups: dict[tuple, list] = {}
    with ThreadPoolExecutor(readers) as pool:
        for files in pool.map(lambda p: _first_lines(spark, p), paths):
            for name, line in files:
                if line is not None:
                    groups.setdefault(header_names(line), []).append(name)
    return groups


def read_flow_csvs(spark: SparkSession, paths: list, label: str = "Label") -> DataFrame:
    """Union by name across files (or folders of part files) whose columns differ, all strings."""
    groups = header_groups(spark, paths)
    if not groups:
        raise ValueError("no CSV file has a header")

    def scan(names: tuple, files: list) -> DataFrame:
        # Positions, not names, tie fields to the schema, so that names that repeat once trimmed stay apart.
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(files))
        return repeated_header_filter(df.toDF(*names), label)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [scan(names, files) for names, files in groups.items()])


def write_csv(df: DataFrame, path: str, num_files: int | None = None) -> None:
    """Overwrite-mode CSV with header.  ``num_files`` coalesces the output
    (the reference uses 8); leave it None on large data so every task writes
    its own file instead of funnelling the table through a few tasks."""
    out = df.coalesce(num_files) if num_files else df
    (out.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_two_flow_files(dl: DataFrame, base: str, only_a: list, only_b: list) -> list:
    """Fixture writer: rows with ``__file`` a/b go to two CSV folders with
    different column sets; file b has reversed column order and header
    names padded with spaces (exercises trim and union by name)."""
    cols = [c for c in dl.columns if c != "__file"]
    a_cols = [c for c in cols if c not in only_b]
    b_cols = [c for c in reversed(cols) if c not in only_a]
    a = dl.filter(col("__file") == "a").select(*[col(c) for c in a_cols])
    b = dl.filter(col("__file") == "b").select(*[col(c).alias(f" {c} ") for c in b_cols])
    pa, pb = base + "/part_a.csv", base + "/part_b.csv"
    write_csv(a, pa)
    write_csv(b, pb)
    return [pa, pb]
