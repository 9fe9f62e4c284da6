import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) with other columns whose names clash with those of results."""

    def make(rows, partitions=3):
        frame = spark.createDataFrame(list(rows), "doc_id long, text string").repartition(partitions)
        extra = {c: F.lit(7) for c in ("start", "length", "n_words", "spans", "words", "row", "bucket", "payload", "kind", "fp", "key", "score", "label", "_m", "lines", "classes")}
        return frame.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit("s"), "n_chars": F.length("text"), **extra})

    return make


#: Null and empty texts, white space only, a null id, repeated rows, ties and a very long text.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a row without an id"), (4, "again and again"), (4, "again and again"), (5, "again and again"), (6, "word " * 60_000), (7, "x" * 200_000), (8, "ünï çödé ﬀ ①   \x00 \x1c 🙂 'S n't"), (-9, "negative id")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def real(spark, sf):
    return [(r["doc_id"] + 5000, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
