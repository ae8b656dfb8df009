"""The entry point without the llm folders, and with one of their requirements missing."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copied(tmp_path, llm):
    shutil.copytree(os.path.join(ROOT, "graphloom"), tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if llm:
        os.mkdir(tmp_path / "graphloom/llm")
        (tmp_path / "graphloom/llm/__init__.py").write_text("")
        (tmp_path / "graphloom/llm/queries.py").write_text("import a_library_that_is_not_there\n")
        (tmp_path / "corpus_pipeline.py").write_text("")


def names(tmp_path):
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)


def test_the_subpackage_can_be_taken_away(tmp_path):
    copied(tmp_path, llm=False)
    out = names(tmp_path)
    assert out.returncode == 0 and out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 30, out.stderr


def test_a_missing_library_is_an_error(tmp_path):
    copied(tmp_path, llm=True)
    assert "a_library_that_is_not_there" in names(tmp_path).stderr
