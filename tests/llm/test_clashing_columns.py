"""Tables with extra columns that have the operators' own column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseload.llm import exact_dedup, line_dedup, near_dedup, packing, substring_dedup

from .conftest import SF

NAMES = ["_removed", "_id", "gone", "id", "n", "h1", "h2", "rep", "mark", "counts", "comp", "key", "sha", "points", "row", "range", "maybe",
         "starts", "ends", "kept", "node", "label", "bucket", "item", "need", "score", "words", "anchor", "size", "keep_id", "component_id"]


@pytest.fixture
def both(spark):
    """The small documents, plain and with every name of ``NAMES`` as an extra text column."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    extra = plain.select("*", *[F.lit("x").alias(n) for n in NAMES])
    return plain, extra


def rows(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, packing.pack_documents, near_dedup.near_duplicates,
                                      exact_dedup.exact_dedup])
def test_operators(both, operator):
    plain, extra = (operator(docs) for docs in both)
    columns = [c for c in plain.columns if c not in ("sequence_id", "offset")]  # these depend on the partitions
    assert rows(plain, columns) == rows(extra, columns)


def test_lines(both):
    plain, extra = (line_dedup.drop_repeated_lines(docs) for docs in both)
    assert extra.columns == [*both[1].columns, "__removed"]
    assert rows(plain, ["doc_id", "text", "_removed"]) == rows(extra, ["doc_id", "text", "__removed"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, both, name, stage):
    plain, extra = (stage(spark, docs, SF) for docs in both)
    assert extra.columns == both[1].columns
    assert rows(plain, plain.columns) == rows(extra, plain.columns)
