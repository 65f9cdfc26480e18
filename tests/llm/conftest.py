import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A shared folder for stored tables, as a cluster names one in spark.checkpoint.dir."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) or (doc_id, text, source) rows, with columns of clashing names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", 0 if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("h", "score", "part", "n", "text_hash", "key", "word"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df.repartition(3)

    return make
