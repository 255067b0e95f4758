"""The driver's contract, with and without the optional operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_operators(tmp_path):
    """Without sparrowdeck/llm, tests/llm and corpus_pipeline.py the rest imports and has its queries."""
    for name in ("sparrowdeck", "__spark_entry__.py"):
        source = os.path.join(REPO, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "sparrowdeck" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_without_what_the_optional_operators_need():
    """A missing module takes the optional queries away and no others."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pricing_summary' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": REPO}, check=True, timeout=120)


def test_nothing_else_imports_the_optional_operators():
    for folder, _, files in os.walk(os.path.join(REPO, "sparrowdeck")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                assert ".llm" not in open(os.path.join(folder, f)).read(), f
