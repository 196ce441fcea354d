"""The contract's three functions, and the plans' shape."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["align_overlap", "align_words", "merge_turns", "cross_speaker_duplicates", "in_loop_blocks"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@needs_data
def test_scans_read_only_what_they_need(spark):
    text = entry.queries()["rms_envelope"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "props" not in text.split("ReadSchema")[1]


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest stands without the llm folders and the pipeline."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
