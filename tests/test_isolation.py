"""The library without the llm folders: everything else still imports."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TRY = """
import __spark_entry__ as e
assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())
print(sum(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in e.queries()))
"""


def test_library_stands_without_the_llm_folders(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "spark-warehouse"))
    run = lambda: subprocess.run([sys.executable, "-c", TRY], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True)
    with_pipeline = run()
    assert with_pipeline.returncode == 0 and with_pipeline.stdout.split()[-1] == "0", with_pipeline.stderr
    (at / "corpus_pipeline.py").unlink()
    assert run().returncode == 0
    found = subprocess.run(["grep", "-rlE", r"shelfgraph\.llm|corpus_pipeline", str(at / "shelfgraph"), str(at / "tests")], capture_output=True, text=True).stdout.split()
    assert [os.path.basename(f) for f in found] == ["test_isolation.py"]
