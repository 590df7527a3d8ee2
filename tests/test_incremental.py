"""Processing only new or changed records: definition, failures, dirty input."""

import datetime as dt

import pytest

from codelode.operators.incremental import IncrementalRun, due_chunks, processed_ledger, reread_horizon, run_states

T0 = dt.datetime(2025, 1, 1)
CHUNKS = "id bigint, project string, file_path string, revision int, content string, start_line int, end_line int, created_at timestamp_ntz, extra string"
LOG = "run_id bigint, project string, file_path string, file_created_at timestamp_ntz, chunk_count int, logged_at timestamp_ntz"
RUNS = "run_id bigint, project string, updated_at timestamp_ntz, status string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def chunk(i, path, revision, text, created, start=1, project="p"):
    return (i, project, path, revision, text, start, start + (text or "").count("\n"), at(created), "x")


def due(spark, chunks, log, runs, **more):
    frames = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)
    return sorted(r.id for r in due_chunks(*frames, **more).collect())


GOOD = [(1, "p", at(10), "running"), (1, "p", at(11), "succeeded")]


def test_only_what_no_successful_run_has_logged(spark):
    chunks = [chunk(1, "a", 1, "x", 1), chunk(2, "a", 2, "y", 2), chunk(3, "b", 1, "z", 1), chunk(3, "b", 1, "z", 1), chunk(4, "c", 1, "q", 1)]
    log = [(1, "p", "a", at(1), 1, at(11)), (1, "p", "b", at(1), 1, at(11)), (1, "p", "b", at(1), 1, at(11)), (2, "p", "c", at(1), 1, at(12))]
    runs = [*GOOD, (2, "p", at(12), "running"), (2, "p", at(13), "failed")]
    assert due(spark, chunks, log, runs) == [2, 4]
    assert due(spark, chunks, [], runs) == [2, 3, 4]
    assert due(spark, [], log, runs) == []
    assert due(spark, chunks, log, []) == [2, 3, 4]


def test_unchanged_text_is_not_due_even_if_cut_differently(spark):
    chunks = [chunk(1, "a", 1, "x\ny", 1), chunk(2, "a", 1, "z", 1, 3), chunk(3, "a", 2, "x", 2), chunk(4, "a", 2, "y\nz", 2, 2)]
    log = [(1, "p", "a", at(1), 2, at(11))]
    assert due(spark, chunks, log, GOOD) == []
    moved = [*chunks[:3], chunk(4, "a", 2, "z\ny", 2, 2)]
    assert due(spark, moved, log, GOOD) == [3, 4]
    # the earlier revision was logged by a run that failed
    assert due(spark, chunks, log, [(1, "p", at(10), "failed")]) == [3, 4]


def test_nulls_and_late_rows(spark):
    chunks = [chunk(1, None, 1, "x", 1), chunk(2, "a", None, None, 1), chunk(None, "b", 1, "x", 1), (5, "p", "d", 1, "x", 1, 1, None, None)]
    assert due(spark, chunks, [], GOOD) == [1, 2, 5]
    assert due(spark, [chunk(1, "a", 1, "late", 0)], [], GOOD) == [1]


def test_states_and_horizon(spark):
    runs = [*GOOD, (2, "p", at(5), "running"), (3, "p", at(1), "running"), (3, "p", at(2), "succeeded"), (4, "p", at(20), "running"), (5, "q", at(1), None)]
    frame = spark.createDataFrame(runs, RUNS)
    assert {r.run_id: r.status for r in run_states(frame).collect()} == {1: "succeeded", 2: "running", 3: "succeeded", 4: "running", 5: None}
    # run 2 was open when run 1, the last success, began
    assert [(r.project, r.horizon) for r in reread_horizon(frame).collect()] == [("p", at(5))]
    log = spark.createDataFrame([(1, "p", "a", at(1), 1, at(2)), (2, "p", "b", at(1), 1, at(2))], LOG)
    assert [r.file_path for r in processed_ledger(log, frame).collect()] == ["a"]


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    chunks = spark.createDataFrame([chunk(i, f"f{i % 4}", 1 + i // 4, f"t{i}", i // 4) for i in range(8)], CHUNKS)
    log, runs = str(tmp_path / "log"), str(tmp_path / "runs")
    spark.createDataFrame([], LOG).write.parquet(log)
    spark.createDataFrame([], RUNS).write.parquet(runs)
    seen = []

    def take(df):
        seen.append(sorted(r.id for r in df.collect()))

    def break_off(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        IncrementalRun(chunks, log, runs, 1).execute(break_off)
    assert IncrementalRun(chunks, log, runs, 2).execute(take) == 4
    assert IncrementalRun(chunks, log, runs, 3).execute(take) == 0
    more = chunks.union(spark.createDataFrame([chunk(20, "f1", 3, "new", 9), chunk(21, "late", 1, "z", 0)], CHUNKS))
    assert IncrementalRun(more, log, runs, 4).execute(take) == 2
    assert seen == [[4, 5, 6, 7], [], [20, 21]]


def test_only_files_that_arrived_since_the_horizon_are_read(spark, tmp_path):
    import os

    from codelode.operators.incremental import arriving

    path, stamp = str(tmp_path / "chunks"), lambda hours: (at(hours) - dt.datetime(1970, 1, 1)).total_seconds()
    parts = [([chunk(1, "old", 1, "x", 1), chunk(9, "b", 2, "y", 2)], 5), ([chunk(2, "late", 1, "x", 0), chunk(3, "b", 1, "y", 1), chunk(4, "old", 2, "z", 3)], 12), ([chunk(5, "copied", 1, "x", 30)], 6)]
    for rows, arrived in parts:
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(path)
        for name in set(os.listdir(path)) - before:
            os.utime(f"{path}/{name}", (stamp(arrived), stamp(arrived)))
    chunks = arriving(spark, path)
    log, runs = spark.createDataFrame([], LOG), spark.createDataFrame(GOOD, RUNS)
    # file b has an old current revision that came before the horizon, and a late older one: all its revisions are looked at
    assert sorted(r.id for r in due_chunks(chunks, log, runs, "_arrived").collect()) == [2, 4, 5, 9]
    early = spark.createDataFrame([(1, "p", at(30), "running"), (1, "p", at(31), "succeeded")], RUNS)
    assert sorted(r.id for r in due_chunks(chunks, log, early, "_arrived").collect()) == [5]
    assert sorted(r.id for r in due_chunks(chunks, log, early).collect()) == [2, 4, 5, 9]
    from codelode.operators.incremental import reread

    narrow = reread(chunks.where("_arrived IS NOT NULL"), runs).select("id")
    assert sorted(r.id for r in narrow.collect()) == [2, 3, 4]


def test_output_and_ledger_become_valid_together(spark, tmp_path, monkeypatch):
    from codelode.operators.incremental import committed_output

    chunks = spark.createDataFrame([chunk(i, f"f{i}", 1, f"t{i}", 1) for i in range(6)], CHUNKS)
    log, runs, out = (str(tmp_path / n) for n in ("log", "runs", "out"))
    spark.createDataFrame([], LOG).write.parquet(log)
    spark.createDataFrame([], RUNS).write.parquet(runs)
    one = IncrementalRun(chunks, log, runs, 1, output_path=out)
    mark = one._mark
    monkeypatch.setattr(one, "_mark", lambda status: mark(status) if status == "running" else (_ for _ in ()).throw(RuntimeError("lost before the end")))
    with pytest.raises(RuntimeError):
        one.execute(lambda df: df.select("id"))
    assert committed_output(spark, out, spark.read.parquet(runs)).count() == 0 and spark.read.parquet(out).count() == 6
    assert IncrementalRun(chunks, log, runs, 2, output_path=out).execute(lambda df: df.select("id")) == 6
    assert IncrementalRun(chunks, log, runs, 3, output_path=out).execute(lambda df: df.select("id")) == 0
    assert sorted(r.id for r in committed_output(spark, out, spark.read.parquet(runs)).collect()) == list(range(6))
