import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, DOCS + extra)
    return make


@pytest.fixture(scope="session")
def folder_of(docs_of, tmp_path_factory):
    """Write rows as a documents table and give its folder."""
    def make(rows, extra=""):
        d = tmp_path_factory.mktemp("docs")
        docs_of(rows, extra).write.parquet(f"{d}/documents.parquet")
        return str(d)
    return make


@pytest.fixture(scope="session")
def sample():
    import pandas as pd
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
