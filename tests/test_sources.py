"""Readers, writers and streams."""

import gzip
from pathlib import Path

import pytest

from verbena.operators import joins
from verbena.operators.metrics import chunk_epochs, early_stop
from verbena.operators.trials import latest_trial_state
from verbena.sources.corpora import read_corpus, read_lines, read_test_passes
from verbena.sources.journal import (
    JournalSnapshot,
    append_journal,
    journal_files,
    read_journal,
)
from verbena.sources.results import write_results
from verbena.sources.scripts import read_run_configs
from verbena.streaming.early_stop import stream_early_stop, write_stops
from verbena.streaming.trials import (
    compact_updates,
    current_rows,
    stream_latest_trials,
    write_updates,
)


def gz(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as out:
        out.write("".join(f"{line}\n" for line in lines))
    return str(path)


def test_gzip_lines_keep_their_place(spark, tmp_path):
    files = {
        name: [f"{name} {i}" for i in range(n)] for name, n in (("one", 50), ("two", 7), ("three", 1))
    }
    paths = [gz(tmp_path / n / f"{n}.txt.gz", lines) for n, lines in files.items()]
    corpus = read_corpus(spark, paths, "train")
    got = {(r.dataset, r.line_no): r.text for r in corpus.collect()}
    assert got == {(n, i): t for n, lines in files.items() for i, t in enumerate(lines)}
    assert {r.role for r in corpus.collect()} == {"train"}


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_plain_lines_over_many_splits(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", rows)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)]
    (tmp_path / "long.txt").write_text("".join(f"{line}\n" for line in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_lines(spark, str(tmp_path / "long.txt"))
        got = {r.line_no: r.text for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines))


def test_repeated_files_are_passes(spark, tmp_path):
    a = gz(tmp_path / "a" / "a.txt.gz", ["x", "x"])
    b = gz(tmp_path / "b" / "b.txt.gz", ["y"])
    passes = read_test_passes(spark, [a, a, b, b])
    got = sorted((r.pass_no, r.dataset, r.line_no, r.text) for r in passes.collect())
    assert got == [
        (0, "a", 0, "x"), (0, "a", 1, "x"), (1, "a", 0, "x"), (1, "a", 1, "x"),
        (2, "b", 0, "y"), (3, "b", 0, "y"),
    ]
    other = gz(tmp_path / "c +d" / "a.txt.gz", ["z"])
    passes = read_test_passes(spark, [a, other])
    assert sorted((r.pass_no, r.text) for r in passes.collect()) == [(0, "x"), (0, "x"), (1, "z")]


def test_lines_keep_their_numbers_when_splits_change(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)]
    (tmp_path / "a long one.txt").write_text("".join(f"{line}\n" for line in lines))
    spark.conf.set("spark.sql.files.minPartitionNum", "4")
    try:
        df = read_lines(spark, str(tmp_path / "a long one.txt"))
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        got = {r.line_no: r.text for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == dict(enumerate(lines))


SCRIPT = """#!/bin/bash

#SBATCH --job-name=m+n-crined-dr-00

echo "Running --not_an_option"

python core/run.py \\
	--model "'org/model'" \\
	--use_gpu \\
	--steps 2 `# once --per two batches` \\
	--loss.train A \\
				 B \\
	--params.lr.values 1e-9 1e-3 \\
	--files "'a b.txt'" \\
		"'c.txt'" \\
	--save False"""


def test_scripts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "m+n-crined-dr-00.sh").write_text(SCRIPT)
    (tmp_path / "notes.txt").write_text(SCRIPT)
    got = {(r.run_id, r.key, r.pos): r.value for r in read_run_configs(spark, str(tmp_path)).collect()}
    run = "m+n-crined-dr-00"
    assert got == {
        (run, "model", 0): "\"'org/model'\"",
        (run, "use_gpu", 0): None,
        (run, "steps", 0): "2",
        (run, "loss.train", 0): "A",
        (run, "loss.train", 1): "B",
        (run, "params.lr.values", 0): "1e-9",
        (run, "params.lr.values", 1): "1e-3",
        (run, "files", 0): "\"'a b.txt'\"",
        (run, "files", 1): "\"'c.txt'\"",
        (run, "save", 0): "False",
    }


def test_results_keep_other_runs(spark, tmp_path):
    schema = "dataset string, model string, item long"
    root = str(tmp_path / "results")
    df = spark.createDataFrame([("d", "m", i) for i in range(10)], schema)
    write_results(df, root, "t1")
    write_results(df, root, "t2")
    write_results(df.limit(3), root, "t2")
    back = spark.read.parquet(root)
    assert {r.run_ts: r["count"] for r in back.groupBy("run_ts").count().collect()} == {"t1": 10, "t2": 3}


JOURNAL = "trial long, seq long, state string"


def test_streamed_journal_equals_replay(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    seen = []
    for part in ([(1, 1, "a"), (2, 2, "a")], [(1, 4, "c"), (3, 5, "a")], [(1, 3, "b")]):
        append_journal(spark.createDataFrame(part, JOURNAL), log)
        seen += part
        stream = stream_latest_trials(spark, log, JOURNAL, ["trial"], "seq", ["state"], 1)
        write_updates(stream, out, mark).awaitTermination()
        streamed = {tuple(r) for r in current_rows(spark, out, ["trial"], "seq").collect()}
        replay = latest_trial_state(read_journal(spark, log, JOURNAL), ["trial"], "seq", ["state"])
        assert streamed == {tuple(r) for r in replay.collect()}


def test_compacted_updates_keep_the_current_rows(spark, tmp_path):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    seen = {}
    for part in ([(1, 1, "a"), (2, 2, "a")], [(1, 4, "c")], [(3, 5, "a")], [(1, 3, "b"), (2, 6, "d")]):
        append_journal(spark.createDataFrame(part, JOURNAL).coalesce(1), log)
        for trial, seq, state in part:
            seen[trial] = max(seen.get(trial, (0, "")), (seq, state))
        stream = stream_latest_trials(spark, log, JOURNAL, ["trial"], "seq", ["state"])
        write_updates(stream, out, mark).awaitTermination()
        compact_updates(spark, out, ["trial"], "seq")
        streamed = {r.trial: (r.seq, r.state) for r in current_rows(spark, out, ["trial"], "seq").collect()}
        assert streamed == seen
        assert len(list(Path(out).glob("batch=*"))) == 1


def test_resume_reads_the_snapshot_and_newer_files(spark, tmp_path):
    log = str(tmp_path / "log")
    snapshot = JournalSnapshot(spark, str(tmp_path / "kept"), ["trial"], "seq", ["state"], JOURNAL)
    assert snapshot.replay(log).count() == 0
    seen = []
    for turn, part in enumerate(
        ([(1, 1, "a"), (2, 2, None)], [(1, 4, "c")], [(1, 3, "b"), (4, 9, "z")], [(2, 7, "y")])
    ):
        append_journal(spark.createDataFrame(part, JOURNAL), log)
        seen += part
        full = latest_trial_state(spark.createDataFrame(seen, JOURNAL), ["trial"], "seq", ["state"])
        expected = {tuple(r) for r in full.collect()}
        assert {tuple(r) for r in snapshot.replay(log).collect()} == expected
        read = snapshot.newer(log)
        snapshot.compact(log, keep=1)
        assert read and not snapshot.newer(log) and len(snapshot.versions()) == 1
        assert {tuple(r) for r in snapshot.replay(log).collect()} == expected
        if turn == 1:
            snapshot.clear(log)
            assert journal_files(spark, log) == []
    # A snapshot whose list of files is missing was lost half-way and doesn't count.
    broken = tmp_path / "kept" / "99-lost" / "states"
    broken.mkdir(parents=True)
    assert {tuple(r) for r in snapshot.replay(log).collect()} == expected


@pytest.mark.parametrize("run_type", ["long", "string"])
def test_streamed_stops_equal_batch(spark, tmp_path, run_type):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    schema = f"run {run_type}, epoch long, loss double"
    runs = {1: [5, 4, 4, 4, 3, 2, 1], 2: [9, 8, 7, 6], 3: [1, 2, 3, 4, 5, 6], 4: [2, 1, 1, 1, 0]}
    name = int if run_type == "long" else str
    rows = [(name(r), e, float(x)) for r, xs in runs.items() for e, x in enumerate(xs, 1)]
    # Late epochs come first: they have to wait for the gap to be filled.
    for part in (rows[1::2], rows[0::2]):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
        write_stops(stream_early_stop(stream, "run", 2, 3), out, mark).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    batch = early_stop(chunk_epochs(spark.createDataFrame(rows, schema)), "run", 2, 3)
    assert got == {tuple(r)[:4] for r in batch.filter("spent").collect()}
    assert len(got) == 3
