"""The documents fixture of these tests."""


import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table: rows (doc_id, text[, lang, source]), with extra columns
    whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            for name in ("row", "h", "pos", "kept", "size", "slot", "root", "bucket", "m", "copies", "starts", "target", "at"):
                df = df.withColumn(name, F.lit(f"own {name}"))
        return df

    return make
