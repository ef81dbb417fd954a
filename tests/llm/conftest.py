"""Helpers of the training-data operator tests (the session comes from tests/conftest.py)."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents frame from (doc_id, text) pairs, with the columns of the table and two more that clash."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "src0", len(t or ""), "x", 7) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id int"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
