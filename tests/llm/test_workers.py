"""The package need not be installed where the workers run."""

import os
import subprocess
import sys

import pytest

SCRIPT = '''
import sys
sys.path.insert(0, {repo!r})  # for the driver alone; workers start elsewhere, without it
from pitchrank.session import build_session
from pitchrank.llm.queries import QUERIES
spark = build_session(master="local-cluster[1,2,1500]", **{{
    "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.executor.memory": "1000m",
    "spark.checkpoint.dir": {shared!r}, "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"}})
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print("rows of", name, QUERIES[name](spark, {tables!r}).count(), flush=True)
'''
TABLES = "/root/testdata/sf0.001"
NAMES = ["op7_substring_dedup", "op10_language_id", "op11_license_scan", "op12_hard_negatives", "op13_importance_resampling"]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "run.py").write_text(SCRIPT.format(repo=repo, shared=f"file://{tmp_path}/shared", names=NAMES, tables=TABLES))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert [line.split()[2] for line in done.stdout.splitlines() if line.startswith("rows of")] == NAMES, done.stderr[-3000:]
