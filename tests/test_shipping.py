"""Python operators run on executors that do not have the source tree."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_file", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
assert entry.queries()["f2_top_contributions"](spark, entry.SMALL).count() > 0
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, str(ROOT / "__spark_entry__.py"), str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


@pytest.mark.parametrize("gone", [("flowtide/llm",), ("corpus_pipeline.py",), ("flowtide/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), ROOT) in gone])
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    n, pipeline, corpus, oracles = ran.stdout.split()
    assert int(n) > 100 and pipeline == "False" and corpus == str((ROOT / "flowtide/llm/queries.py").exists() and "flowtide/llm" not in gone) and oracles == "True"
