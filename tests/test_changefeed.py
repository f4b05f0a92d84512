from datetime import datetime as D

import pytest

from codeloom.operators.changefeed import ChangeFeed, pending
from codeloom.session import scratch_path

SCANS = "project_id string, path string, content_hash string, scanned_at timestamp"
FILES = "project_id string, path string, content_hash string, indexed_at timestamp, error string"
RUNS = "id long, project_id string, started_at timestamp, status string"


def at(day):
    return D(2025, 1, day)


@pytest.fixture
def state(spark):
    files = spark.createDataFrame([
        ("p", "same", "aa", at(2), None), ("p", "hash", "aa", at(2), None), ("p", "err", "aa", at(2), ""), ("p", "old", "bb", at(1), None), ("p", "old", "aa", at(3), None),
        ("p", "failed", "aa", at(10), None), ("p", "early", "aa", D(2024, 1, 1), None), ("q", "same", None, at(2), None), (None, "x", "aa", at(1), None),
    ], FILES)
    runs = spark.createDataFrame([(1, "p", at(1), "completed"), (2, "p", at(5), "completed_with_errors"), (3, "p", at(9), "failed"), (4, "q", None, "failed"), (5, None, at(1), "failed")], RUNS)
    return files, runs


def scan_rows(extra=()):
    return [("p", "same", "AA", at(20)), ("p", "hash", "aa", at(19)), ("p", "hash", "cc", at(20)), ("p", "err", "aa", at(20)), ("p", "old", "AA", at(20)), ("p", "failed", "aa", at(20)),
            ("p", "early", "aa", at(20)), ("p", "new", None, at(20)), ("q", "same", None, at(20)), (None, "x", "aa", at(20)), ("p", None, "aa", at(20)), ("p", "same", "AA", at(20)), *extra]


def runner(spark, state, root):
    files, runs = state
    return ChangeFeed(spark, root + "/log", root + "/state", buckets=4), lambda rows: pending(rows, files, runs)


def got(feed):
    return {(r.project_id, r.path): r.reason for r in feed.delivered().collect()}


EXPECTED = {("p", "hash"): "changed", ("p", "err"): "error", ("p", "failed"): "unfinished_run", ("p", "new"): "new"}


def test_reasons_nulls_case_and_latest_rows(spark, state):
    root = scratch_path(spark, "feed")
    spark.createDataFrame(scan_rows(), SCANS).repartition(3).write.parquet(root + "/log")
    feed, process = runner(spark, state, root)
    feed.run(process)
    assert got(feed) == EXPECTED


@pytest.mark.parametrize("point", ["sink", "state", "commit"])
def test_a_failed_run_is_replayed_with_the_same_rows(spark, state, point):
    root = scratch_path(spark, "feed")
    spark.createDataFrame(scan_rows(), SCANS).write.parquet(root + "/log")
    feed, process = runner(spark, state, root)
    with pytest.raises(RuntimeError):
        feed.run(process, fail_before=point)
    assert feed.committed() is None
    spark.createDataFrame([("p", "later", "zz", at(25))], SCANS).write.mode("append").parquet(root + "/log")
    assert feed.run(process) == 0
    assert got(feed) == EXPECTED and feed.committed().count() == len(EXPECTED)
    assert feed.run(process) == 1
    assert got(feed) == EXPECTED | {("p", "later"): "new"} and feed.committed().count() == len(EXPECTED) + 1


def test_an_older_record_of_a_delivered_path_is_not_delivered_again(spark, state):
    root = scratch_path(spark, "feed")
    spark.createDataFrame(scan_rows(), SCANS).write.parquet(root + "/log")
    feed, process = runner(spark, state, root)
    feed.run(process)
    spark.createDataFrame([("p", "new", "01", at(18)), ("p", "hash", "dd", at(21))], SCANS).write.mode("append").parquet(root + "/log")
    feed.run(process)
    rows = {r.path: r.content_hash for r in feed.delivered().collect()}
    assert rows["hash"] == "dd" and rows["new"] is None
    assert feed.run(process) == 2 and feed.committed().count() == len(EXPECTED) + 1


def batches_of(spark, state, *batches):
    """What each of several runs delivered, each run after its rows were appended."""
    root, out = scratch_path(spark, "feed"), []
    feed, process = runner(spark, state, root)
    for rows in batches:
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(root + "/log")
        n = feed.run(process)
        out.append({(r.path, r.content_hash) for r in spark.read.parquet(f"{root}/state/sink/batch={n}").collect()})
    return out


def test_equal_and_null_times_are_neither_skipped_nor_repeated(spark, state):
    first = [("p", "a", "h1", at(20)), ("p", "b", "h1", None)]
    again = [("p", "a", "H1", at(20)), ("p", "b", "h1", None)]
    other = [("p", "a", "h0", at(20)), ("p", "b", "h2", None)]
    late = [("p", "a", "h3", None), ("p", "a", "h9", at(19)), ("p", "b", "h1", at(5))]
    assert batches_of(spark, state, first, again, other, late, [("p", "a", "h3", None)]) == [
        {("a", "h1"), ("b", "h1")}, set(), {("a", "h0"), ("b", "h2")}, {("b", "h1")}, {("a", "h3")},
    ]


def test_a_run_opens_only_its_own_files(spark, state, tmp_path):
    root = str(tmp_path)
    feed, process = runner(spark, state, "file://" + root)
    for day in (20, 21, 22):
        before = set((tmp_path / "log").glob("*.parquet"))
        spark.createDataFrame([("p", f"new{day}", "x", at(day))], SCANS).coalesce(1).write.mode("append").parquet(f"file://{root}/log")
        feed.run(process)
        (fresh,) = set((tmp_path / "log").glob("*.parquet")) - before
        fresh.write_bytes(b"gone")  # whoever opens it again fails
        fresh.with_name(f".{fresh.name}.crc").unlink(missing_ok=True)
    assert feed.committed().count() == 3


def test_a_log_with_clashing_columns(spark, state):
    root = scratch_path(spark, "feed")
    rows = spark.createDataFrame(scan_rows(), SCANS)
    for name in ("log_file", "log_offset", "first", "end", "reason", "stored", "r", "batch"):
        rows = rows.selectExpr("*", f"'x' as {name}")
    rows.write.parquet(root + "/log")
    feed, process = runner(spark, state, root)
    feed.run(process)
    assert got(feed) == EXPECTED


def test_empty_tables(spark, state):
    files, runs = state
    root = scratch_path(spark, "feed")
    spark.createDataFrame([], SCANS).write.parquet(root + "/log")
    feed, process = runner(spark, state, root)
    feed.run(process)
    assert feed.delivered().count() == 0
    log = spark.createDataFrame([("p", "a", "x", at(1), "f", 0)], SCANS + ", log_file string, log_offset long")
    assert [r.reason for r in pending(log, files.limit(0), runs.limit(0)).collect()] == ["new"]
