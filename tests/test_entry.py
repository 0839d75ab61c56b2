"""The entry without the folders of the training-data operators, on a copied tree."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(tree):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tree, env=os.environ | {"PYTHONPATH": f"{tree}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [line.split() for line in out.stdout.splitlines()]


def test_import_with_and_without_the_folders(tmp_path):
    left_out = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "bare", ignore=lambda folder, found: {*left_out(folder, found), *({"llm", "corpus_pipeline.py"} & set(found))})
    bare, sql = names(tmp_path / "bare")
    assert len(bare) > 50 and set(sql) <= set(bare) and not [n for n in bare if n.startswith("op") or n == "pipeline"]
    shutil.copytree(HERE, tmp_path / "half", ignore=lambda folder, found: {*left_out(folder, found), *({"llm"} & set(found))})
    assert names(tmp_path / "half") == [bare, sql]
