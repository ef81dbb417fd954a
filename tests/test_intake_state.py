"""Streaming intake: keyed state instead of a join with the stored table (T1), reports by parts."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from caseload import schema as S
from caseload.operators import intake, partials, planning, reports
from caseload.session import checkpoint_dir
from caseload.streaming.intake_stream import new_records, parts_path, process_batch, start_stream

RECORDS = "intake_id bigint, response string"


@pytest.fixture
def job(spark, tmp_path):
    """Runs the stream over one more file of responses; the table's path is ``job.table``."""

    class Job:
        source, table, quarantine, checkpoint = (f"{tmp_path}/{x}" for x in ("source", "table", "quarantine", "ckpt"))

        def __call__(self, rows, **options):
            spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(self.source)
            start_stream(spark, self.source, self.table, self.quarantine, self.checkpoint, **options).awaitTermination()

        def rows(self):
            out = spark.read.parquet(self.table).select("family_num", "intake_id", "city", "intake_batch").collect()
            return sorted(tuple(r) for r in out)

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Job()
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def city(name, size=3):
    return f'{{"city": "{name}", "family_size": "{size}"}}'


def test_resends_across_batches(spark, job):
    job([(1, "malformed {"), (2, city("B")), (None, city("N")), (None, city("N")), (2, "worse {")], start_number=10)
    job([(1, city("A")), (2, city("changed")), (None, city("N")), (4, "{"), (3, city("C")), (3, city("C"))])
    job([(1, city("A again")), (4, city("D"))])
    assert job.rows() == [(11, 2, "B", 0), (12, None, "N", 0), (13, None, "N", 0),
                          (14, 1, "A", 1), (15, 3, "C", 1), (16, None, "N", 1), (17, 4, "D", 2)]
    bad = sorted(tuple(r) for r in spark.read.parquet(job.quarantine).select("intake_id", "intake_batch").collect())
    assert bad == [(1, 0), (2, 0), (4, 1)]
    ids = {r.intake_id: r.family_id for r in spark.read.parquet(job.table).collect() if r.intake_id}
    assert len(set(ids.values())) == 4


def test_first_good_record_is_the_same_in_any_order(spark):
    rows = [(1, city("A")), (1, city("B")), (1, "x"), (None, city("B")), (None, city("B")), (2, "{"), (3, city("C"))]
    pick = lambda rs: sorted(((r.intake_id, r.city) for r in intake.first_records(
        intake.parse_responses(spark.createDataFrame(rs, RECORDS).repartition(3))).collect()), key=repr)
    assert pick(rows) == pick(rows[::-1])
    assert [i for i, _ in pick(rows)] == [1, 3, None, None]


def test_batch_and_stream_have_one_rule(spark, job, golden_cases):
    first = [(1, "{"), (2, city("B")), (2, city("B2")), (None, city("N"))]
    second = [(1, city("A")), (2, city("other")), (None, city("N"))]
    job(first, start_number=6)
    job(second)
    table = golden_cases
    for rows in (first, second):
        parsed = intake.parse_responses(spark.createDataFrame(rows, RECORDS))
        table = intake.append(table, intake.score_intake(intake.first_records(parsed)))
    appended = table.where(F.col("source_file") == S.MANUAL_SOURCE_FILE).select("family_num", "family_id", "city")
    streamed = spark.read.parquet(job.table).select("family_num", "family_id", "city")
    assert sorted(map(tuple, appended.collect())) == sorted(map(tuple, streamed.collect()))


def test_a_batch_reads_no_stored_row(spark, job):
    """Later batches run, and know the stored ids, with every file of the stored table unreadable."""
    job([(i, city("A")) for i in range(50)])
    stored = glob.glob(f"{job.table}/intake_batch=0/*.parquet")
    assert stored
    for path in stored:
        with open(path, "wb") as f:
            f.write(b"not a table")
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.unlink(crc)
    job([(7, city("again")), (50, city("B")), (None, city("C"))])
    rows = spark.read.parquet(f"{job.table}/intake_batch=1").select("family_num", "intake_id").collect()
    assert sorted(map(tuple, rows), key=repr) == [(51, 50), (52, None)]


def test_a_failed_batch_is_repeated_without_loss(spark, job):
    def fail(_):
        raise RuntimeError("lost before the commit")

    job([(1, city("A"))])
    with pytest.raises(Exception, match="lost before the commit"):
        job([(2, city("B")), (1, city("x")), (None, city("N"))], on_commit=fail)
    job([(3, city("C")), (2, city("y"))])
    assert job.rows() == [(1, 1, "A", 0), (2, 2, "B", 1), (3, None, "N", 1), (4, 3, "C", 2)]
    totals = partials.totals(spark, parts_path(job.table)).first()
    assert totals.families == 4


def test_another_checkpoint_is_refused(spark, job, tmp_path):
    job([(1, city("A"))])
    with pytest.raises(ValueError, match="another checkpoint"):
        start_stream(spark, job.source, job.table, job.quarantine, f"{tmp_path}/new")


def test_scratch_does_not_grow(spark, job):
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    for n in range(10):
        process_batch(spark.createDataFrame([(n, city("A")), (None, "{")], RECORDS), n, job.table, job.quarantine)
        assert set(os.listdir(root)) == before
    assert len(job.rows()) == 10


def test_parts_add_up_to_the_whole(spark, job, golden_cases):
    seen = []
    options = {"start_number": 6, "caseload": golden_cases, "on_commit": lambda t: seen.append(t.count())}
    job([(1, city("G1", 9)), (2, '{"housing_type": "%s", "breadwinners": "0"}' % S.HOUSING_HOMELESS)], **options)
    job([(1, city("again")), (3, city("Q", "many")), (None, city("S1", 1))], **options)
    assert seen == [2, 4]
    stored = spark.read.parquet(job.table).drop("intake_id", "intake_batch")
    whole = golden_cases.withColumn("family_id", F.col("family_id").cast("string")).unionByName(stored, allowMissingColumns=True)
    root = parts_path(job.table)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    expected = planning.needs_report_table(whole).collect()
    assert sorted(partials.needs_report(spark, root).collect(), key=repr) == sorted(expected, key=repr)
    assert same(partials.headline(spark, root), reports.headline(whole))
    assert same(partials.signal_totals(spark, root), reports.signal_totals(whole))
    assert same(partials.top_cities(spark, root, 3), reports.top_by_count(whole, "city", 3))
    assert same(partials.mean_scores(spark, root, 3), reports.top_by_mean(whole, "city", "priority_score", 3))
    # a batch replayed by hand overwrites its own part
    process_batch(spark.createDataFrame([(1, city("again")), (3, city("Q", "many")), (None, city("S1", 1))], RECORDS), 1,
                  job.table, job.quarantine, start_number=6)
    assert sorted(partials.needs_report(spark, root).collect(), key=repr) == sorted(expected, key=repr)
    files = partials.needs_report(spark, root).inputFiles()
    assert len(files) == 3 and all("table_parts/totals" in f for f in files)


def test_each_response_is_parsed_once_a_branch(spark):
    """No filter repeats the JSON parse below the projections that hold it."""
    rows = spark.createDataFrame([(1, city("A")), (2, "{"), (None, city("N")), (None, "x")], RECORDS)
    out = new_records(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("from_json" in line or "jsontostructs" in line.lower())]
    assert sorted((r.intake_id or 0, r.parse_ok, r.city) for r in out.collect()) == [
        (0, False, None), (0, True, "N"), (1, True, "A"), (2, False, None)]
