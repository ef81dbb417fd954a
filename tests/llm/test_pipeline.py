"""The pipeline: every stage against a brute-force version on that stage's own input."""

import subprocess
import sys

import corpus_pipeline
from caseload.llm import quality, registry

from . import test_decontaminate, test_line_dedup, test_near_dedup, test_packing
from .conftest import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if k < 5 else {}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        result = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert result.columns == COLUMNS
            after = {r.doc_id: r.text for r in result.collect()}
            assert all(r.n_chars == len(r.text) for r in result.where("n_chars <> length(text)").collect()) or k != 1
        seen[name] = (before, after if k < 4 else result.collect())
        if k == 0:
            judged = quality.assess(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in judged.where("kept").collect()}
            assert all(before[i] == t for i, t in after.items())
        docs = result

    before, after = seen["line dedup"]
    expected = {i: t for i, (t, gone) in test_line_dedup.brute(list(before.items())).items() if not gone or t.strip()}
    assert after == expected
    before, after = seen["near dedup"]
    assert after == {i: before[i] for i, (_, _, kept) in test_near_dedup.brute(list(before.items())).items() if kept}
    before, after = seen["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = {d for d, _ in test_decontaminate.brute(list(before.items()), items)}
    assert after == {i: t for i, t in before.items() if i not in found}
    before, pieces = seen["packing"]
    test_packing.check(pieces, before)


def test_run_gives_the_rows_of_the_last_stage(spark, docs_of, tmp_path):
    sf = str(tmp_path)
    text = "the first line of a text with more than ten words in it\nand one more line\n"
    docs_of([(i, text * 2 + f"number {i} " * (5 + i)) for i in range(12)] + [(50, None), (51, "")]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {50, 51} <= {r.doc_id for r in rows} and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_empty_table(spark, docs_of, tmp_path):
    sf = str(tmp_path)
    docs_of([]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered_once_and_optional(tmp_path):
    assert {q.split("_")[0] for q in registry.QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}
    code = "import sys; sys.modules['caseload.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'case_flags' in q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
