import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows as documents; texts only are given."""
    def make(texts, first=0):
        rows = [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in
                (x if isinstance(x, tuple) else (n + first, x) for n, x in enumerate(texts))]
        return spark.createDataFrame(rows, DOC)
    return make


@pytest.fixture(scope="session")
def clashing():
    """The frame with further columns named like an operator's own."""
    def add(df):
        for name in ("kind", "target", "rep", "component", "band", "host", "path", "u", "v", "score", "n_shingles",
                     "kept", "spans", "fold", "word", "row", "k"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(1))
        return df
    return add
