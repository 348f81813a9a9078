import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs(spark):
    """Builds a documents frame from (doc_id, text) rows, with a column whose name could clash."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id string")

    return build
