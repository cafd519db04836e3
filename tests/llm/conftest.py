import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""
    def make(pairs, parts=3):
        rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 1.5, "y") for i, t in pairs]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, digest string"
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)
    return make
