"""The driver contract, with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["px", "py", "value"] and df.count() == 256
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    names = run(copy, "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()")
    assert "slice_xy" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_nothing_else_imports_the_training_data_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "voxelarium")):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                assert "voxelarium.llm" not in open(os.path.join(folder, name)).read(), name
