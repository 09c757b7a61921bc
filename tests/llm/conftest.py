import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hits string, _spans string, h long, comp string"
LONG = "word " * 30_000
TIED = "One two three four five six seven. Eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen eighteen. " * 2
ROWS = [(1, TIED, "en", "s"), (2, TIED, "en", "s"), (3, None, "en", "s"), (4, "", None, None), (5, " \n\t ", "en", None), (6, LONG, "en", "s"), (6, LONG, "en", "s"), (None, TIED, "en", "s"), (7, "short one", "en", "s"), (8, "é" * 300, None, "s"), (9, "123 $$$ !!!", "fr", "s"), (10, TIED, "en", "s"), (10, "A short one.", "en", "s"), (11, TIED + "And more.", None, "s")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long, equal and repeated rows, and columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
