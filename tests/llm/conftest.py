import pytest


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang), with columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    def make(rows):
        rows = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        extra = {c: F.lit("x") for c in ("node", "keys", "n", "cell", "root", "_text", "row", "cuts", "gone", "_part", "unit", "held", "block", "sigs", "words")}
        return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra})

    return make


ODD = [(None, "one two three"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "é" * 3), (6, "word " * 30_000), (7, "a" * 100_000), (None, None)]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([(1, "x")]).limit(0)
