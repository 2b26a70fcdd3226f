"""The registered queries without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e, sys; print(len(e.queries()), len(e.oracle_sql()), any(m.startswith('weft.llm') for m in sys.modules)); assert set(e.oracle_sql()) <= set(e.queries())"


def test_entry_imports_when_the_subpackage_is_deleted(tmp_path):
    """With and without corpus_pipeline.py, which needs the subpackage."""
    for name in ("weft", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        n, with_sql, loaded = done.stdout.split()
        assert int(n) > 90 and int(with_sql) > 90 and loaded == "False"
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
