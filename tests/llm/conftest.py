import pytest
from pyspark.sql import functions as F

#: Extra columns whose names the operators use inside.
CLASHING = ("row", "fp", "root", "words_", "length", "doc", "stratum", "bucket_", "id", "token", "h", "name")
LONG = "lorem ipsum dolor sit amet consectetur " * 9000
ODD = [
    (900001, None, "en"), (900002, "", "en"), (900003, " \n\t \x0b", None), (None, "a row without an id", "de"),
    (900004, "twice here " * 70, "en"), (900004, "twice here " * 70, "en"), (900005, "é ü 漢字 \U0001f600 x", None),
    (900006, LONG, "en"), (900007, "same id, other text", "fr"), (900007, "", "fr"), (900008, " one\u0085two", "fr"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty, long, repeated and non-ASCII rows, with clashing column names."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return rows.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def docs(spark, sf_dir, odd):
    """Documents of the smallest tables and the odd rows."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return given.unionByName(odd.select("doc_id", "text", "lang")).repartition(4, "doc_id").cache()


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
