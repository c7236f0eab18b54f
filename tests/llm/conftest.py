import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts; None is a null text. Extra columns have names that operators use themselves."""

    def build(texts, ids=None, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F

        return df.withColumn("rank", F.lit("x")).withColumn("n", F.lit(1)).withColumn("shingle", F.lit("y"))

    return build
