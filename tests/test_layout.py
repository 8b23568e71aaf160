"""The library, its queries and its tests do without the package that prepares text."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_imports_without_the_text_package(tmp_path, with_pipeline):
    for part in ("sensorloom", "checks", "tests"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * with_pipeline):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = run("-c", COUNT)
    assert found.returncode == 0, found.stderr
    n, pipeline, operators = found.stdout.split()
    assert int(n) >= 75 and pipeline == operators == "False"
    collected = run("-m", "pytest", "tests", "--collect-only", "-q")
    assert collected.returncode == 0, collected.stdout + collected.stderr


def test_nothing_else_imports_the_text_package():
    for path in [*(ROOT / "sensorloom").rglob("*.py"), *(ROOT / "checks").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_layout.py":
            assert "sensorloom.llm" not in path.read_text() and "import llm" not in path.read_text(), path
