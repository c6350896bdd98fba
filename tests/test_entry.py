import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", [False, True])
def test_without_text_operators(tmp_path, left):
    """The rest imports, and registers its queries, where the text subpackage and pipeline are gone."""
    shutil.copytree(f"{ROOT}/zephyrine", tmp_path / "zephyrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / "zephyrine/llm/__pycache__").mkdir(parents=True)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not [x for x in q if x.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"],
        cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert said.returncode == 0, said.stderr


def test_nothing_outside_imports_the_text_operators():
    for folder, _, names in os.walk(f"{ROOT}/zephyrine"):
        if "/llm" in folder or "__pycache__" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                assert "zephyrine.llm" not in open(os.path.join(folder, name)).read(), name
