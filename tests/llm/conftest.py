import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with what operators add."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            df = df.selectExpr("*", "1 as shard", "'x' as h", "2 as p", "3 as score", "4 as pos", "5 as cell", "6 as n", "7 as rank", "8 as words")
        return df

    return build


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"
