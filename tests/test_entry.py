"""The entry module without the optional part, and the shared folder's refusals."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest

from huestrata.sources.shared import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def queries_in(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return [int(n) for n in done.stdout.split()], done.stderr


def copy_without(tmp_path, *left_out):
    folder = tmp_path / "copy"
    shutil.copytree(ROOT, folder, ignore=lambda _, names: [n for n in names if n in (".git", "__pycache__", *left_out)])
    return folder


def test_without_the_optional_part_nothing_is_said(tmp_path):
    (every, ops), said = queries_in(copy_without(tmp_path, "llm", "corpus_pipeline.py"))
    assert every > 60 and ops == 0 and "left out" not in said


@pytest.mark.skipif(not os.path.exists(f"{ROOT}/corpus_pipeline.py"), reason="the optional part is not here")
def test_a_broken_import_in_the_optional_part_is_told(tmp_path):
    folder = copy_without(tmp_path)
    with open(folder / "corpus_pipeline.py", "a") as file:
        file.write("\nimport no_such_module\n")
    (every, ops), said = queries_in(folder)
    assert every > 60 and ops == 0 and "no_such_module" in said


def test_a_local_warehouse_is_refused_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    settings = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, *rest: settings.get(key, *rest)))
    with pytest.raises(ValueError):
        shared_folder(session)
