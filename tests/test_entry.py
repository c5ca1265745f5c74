"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LLM = ["leafmill/llm", "tests/llm"]


@pytest.mark.parametrize("gone", [LLM, [*LLM, "corpus_pipeline.py"]])
def test_the_library_stands_without_llm(tmp_path, gone):
    for name in ("leafmill", "tests", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        at = os.path.join(ROOT, name)
        if os.path.isdir(at):
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(at):
            shutil.copy(at, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(o) - set(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr
    total, dealt, strange = got.stdout.split(maxsplit=2)
    assert int(total) > 100 and dealt == "0" and strange.strip() == "set()"
