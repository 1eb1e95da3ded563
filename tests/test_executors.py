"""Functions reach Python workers that cannot import the package."""

import os
import subprocess
import sys

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from panelforge.session import build_session
spark = build_session("away", master="local[2]", spark__sql__shuffle__partitions=4, spark__checkpoint__dir={scratch!r})
from panelforge.catalog import REGISTRY
print("ROWS", REGISTRY["impute_segment"].run(spark, "/root/testdata/sf0.001").count())
"""


def test_a_query_with_python_runs_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "away.py"
    script.write_text(SCRIPT.format(repo=repo, scratch=str(tmp_path / "scratch")))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    assert "ROWS " in ran.stdout, ran.stderr[-2000:]
