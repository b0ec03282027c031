"""What the plans must and must not hold."""

import pathlib

import pytest

import __spark_entry__ as entry
from verbena.plans import registry
from verbena.session import fresh_path, shared_folder

ROOT = pathlib.Path(entry.__file__).parent
SOURCES = sorted(p for p in (ROOT / "verbena").rglob("*.py") if "llm" not in p.parts)


def plan_of(df):
    """The physical plan before it runs, also of a frame that has run already."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(frame):
    return {name: plan_of(frame(name)) for name in registry.QUERIES}


def test_no_cross_join_and_no_row_python(plans):
    for name, plan in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, (name, bad)


def test_scans_read_only_what_they_need(plans):
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plans["shuffle_order"]
    assert "ReadSchema: struct<text:string,source:string>" in plans["fit_unigram"]


def test_tokens_and_masks_need_no_shuffle(plans):
    """Only the one deal of a single input file, none by key."""
    for name in ("tokenize", "mask_word_tokens", "mask_random_tokens", "mask_targets", "mask_text"):
        assert "hashpartitioning" not in plans[name], name


def test_one_task_sees_only_totals(plans):
    """Rows meet in one partition only as partial aggregates or as totals of chunks."""
    for name, plan in plans.items():
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                aggregate = "Aggregate(keys=[], " in lines[i - 1]
                totals = "_chunk" in lines[i + 1].partition("HashAggregate(keys=[")[2].partition("]")[0]
                assert aggregate or totals, (name, lines[i - 1 : i + 2])


def test_words_kept_out_of_the_library():
    for path in SOURCES:
        text = path.read_text()
        for bad in ("localCheckpoint", "crossJoin", ".collect()", ".toPandas()", ".rdd"):
            assert bad not in text, (path, bad)


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_every_query_has_a_twin():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.SQL) <= set(entry.oracle_sql())
