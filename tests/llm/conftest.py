import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents, with clashing and null columns."""

    def make(rows, **extra):
        full = [(i, t, None, None, None, *extra.values()) for i, t in rows]
        names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in extra)
        return spark.createDataFrame(full, names)

    return make
