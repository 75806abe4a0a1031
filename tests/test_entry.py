"""The entry point without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_stands_without_the_subpackage(tmp_path, pipeline):
    """The package is copied without llm, with and without corpus_pipeline.py: the entry point still offers every other query."""
    shutil.copytree(ROOT / "orbitframe", tmp_path / "orbitframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path)
    from orbitframe.queries import ORACLE_SQL, QUERIES

    run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    others = sum(k.startswith("op") for k in QUERIES)
    assert run.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), str(others), "False"]
