import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in entry.queries() if n.startswith("op")} in (set(), {n for n in entry.queries() if n[:2] == "op" and n[2].isdigit()})


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'near_dup_pairs' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n); assert set(e.oracle_sql()) == set(n); import echolot.cli"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})


def test_nothing_outside_imports_the_optional_subpackage():
    for p in (ROOT / "echolot").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"echolot[./]llm|import llm|from \.+llm", p.read_text()), p
