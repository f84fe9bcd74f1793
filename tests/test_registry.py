"""The registry without the corpus operators."""

import shutil
import subprocess
import sys

from conftest import ROOT

ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))"


def asked(folder):
    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return run.stdout.split()


def copied(target, *without):
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", *without))
    return target


def test_registry_without_the_corpus_package(tmp_path):
    from reviewminer.plans.oracles import ORACLES
    from reviewminer.plans.queries import QUERIES

    expected = [str(len(QUERIES)), str(len(ORACLES)), "False", "False"]
    assert asked(copied(tmp_path / "with_pipeline_file")) == expected
    assert asked(copied(tmp_path / "without", "corpus_pipeline.py")) == expected
