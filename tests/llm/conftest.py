import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like frames from (id, text) pairs, with an extra column whose name clashes with a result's."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return df.withColumnRenamed("lang", "copies") if extra else df

    return make
