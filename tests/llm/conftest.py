import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def write_tables(spark, tmp_path):
    """write_tables(documents=(rows, schema), …) -> folder that reads like a given one."""
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
