import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["loomtext/llm", "tests/llm"], ["loomtext/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for path in gone:
        if os.path.isdir(at / path):
            shutil.rmtree(at / path)
        elif os.path.exists(at / path):
            os.remove(at / path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=at, env=env, capture_output=True, text=True)
    assert not said.returncode, said.stderr
    names, sql = (set(x.split()) for x in said.stdout.strip().split("\n"))
    assert {"wer_raw_corpus", "normalize_text", "ciderd_sentence"} <= names and sql <= names
    assert not any(n.startswith("op") or n == "pipeline" for n in names | sql)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "loomtext")):
        if "llm" not in folder.split(os.sep):
            assert not any("llm" in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))
