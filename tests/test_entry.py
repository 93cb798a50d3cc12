"""The entry module without the optional subpackage, and with a broken one."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def copy(to):
    shutil.copytree(os.path.join(ROOT, "sievemark"), to / "sievemark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)


def imported(at):
    return subprocess.run([sys.executable, "-c", PROGRAM], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage(tmp_path):
    copy(tmp_path)
    done = imported(tmp_path)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 70 and done.stdout.split()[1] == "0"


def test_a_broken_subpackage_is_no_missing_one(tmp_path):
    copy(tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_package_at_all\n")
    done = imported(tmp_path)
    assert done.returncode != 0 and "no_such_package_at_all" in done.stderr
