"""The entry module imports, with the same other queries, where the training-data package is missing."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_training_data_package(tmp_path, pipeline):
    shutil.copytree(ROOT / "lumenfield", tmp_path / "lumenfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout.split()
    assert int(out[0]) > 200 and out[1:] == ["0", "True"]
