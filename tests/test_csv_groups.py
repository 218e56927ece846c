"""Many CSV files, few layouts: one scan for each layout."""

import gzip

import pytest

from swarmsift.sources import csvio


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")


def test_one_scan_for_each_layout(spark, tmp_path):
    layouts = [["Label", "x", " y "], ["y", "Label", "z"], [" y", "x", "Label"]]
    want = []
    for i in range(500):
        names = [c.strip() for c in layouts[i % 3]]
        row = {c: f"{c}{i}" for c in names}
        want.append((row["Label"], row.get("x"), row.get("y"), row.get("z")))
        lines = [",".join(layouts[i % 3]), ",".join(row[c] for c in names)]
        if i % 50 == 0:
            lines.append(",".join(names))  # a header repeated between rows
        (tmp_path / f"f{i:03d}.csv").write_text("\n".join(lines) + "\n")
    df = csvio.read_flow_csvs(spark, csvio.list_csv_files(spark, str(tmp_path)))
    assert df.columns == ["Label", "x", "y", "z"]
    assert scans(df) == 3
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\n"Label, all",Label,,x,X\n1,b,2,3,4\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("Label\n")
    folder = tmp_path / "d.csv"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    (folder / "part-0.csv").write_text("Label,x3\nb,9\n")
    with gzip.open(folder / "part-1.csv.gz", "wt") as f:
        f.write("Label,x3\nc,8\n")
    df = csvio.read_flow_csvs(spark, csvio.list_csv_files(spark, str(tmp_path)))
    # As in Spark's reader: a nameless column is _c2, names that repeat in any case get their position.
    assert df.columns == ["Label, all", "Label", "_c2", "x3", "X4"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [("1", "b", "2", "3", "4"), (None, "b", None, "9", None), (None, "c", None, "8", None)], key=str)
    assert scans(df) == 3


def test_names_as_spark_reads_them(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('Label,a,A,,"q ""x"" y",b c\n1,2,3,4,5,6\n')
    ours = csvio.read_flow_csvs(spark, [str(path)]).columns
    assert ours[:4] + ours[5:] == [c.strip() for i, c in enumerate(spark.read.option("header", True).csv(str(path)).columns) if i != 4]


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csvio.list_csv_files(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("\n")
    with pytest.raises(ValueError):
        csvio.read_flow_csvs(spark, csvio.list_csv_files(spark, str(tmp_path)))
