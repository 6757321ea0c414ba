"""Nothing outside the subpackage imports it, and the library works without it."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_does_not_import_llm():
    for path in (ROOT / "lexforge").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lexforge.llm") or n == "corpus_pipeline" for n in names), path


def test_the_rest_works_without_the_training_operators(tmp_path):
    """A copy without both folders and the pipeline: the entry imports, has the core queries, and a core test passes."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".*")
    for name in ("lexforge", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=_without_repo())
    queries, pipeline, op1, oracles = found.stdout.split()[-4:]
    assert int(queries) > 200 and int(oracles) > 180 and pipeline == op1 == "False", found.stderr[-500:]
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_operators.py", "-k", "components or merges"], cwd=tmp_path, capture_output=True, text=True, env=_without_repo())
    assert ran.returncode == 0, ran.stdout[-800:]


def _without_repo() -> dict[str, str]:
    import os

    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
