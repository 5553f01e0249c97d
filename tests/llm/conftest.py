import pytest


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and odd texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "Alpha beta gamma.\nHome page footer\nDelta", "s1"), (1, "Alpha beta gamma.\nHome page footer\nDelta", "s1"), (2, None, None), (3, "", "s2"), (None, "null id text here", "s1"),
        (4, "  \n\t ", "s3"), (5, "word " * 60000, "s2"), (6, "ünï ßtrange 漢字 <|endoftext|> \x01 'll\r\n  x", "s3"), (7, "Alpha beta gamma.\nHome page footer\nDelta", "s2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    for name in ("row", "key", "hit", "n_words", "_range", "keys", "spans", "length", "component_id", "fp", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df
