"""Python steps run where the workers can not import the package: the session starts in another folder."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.append({repo!r})
from panelwright.runtime import local_session
from panelwright.catalog import load
spark = local_session(cores=2, shuffle_partitions=2)
spark.conf.set("spark.sql.execution.pyspark.udf.faulthandler.enabled", "true")
for name in {names!r}.split():
    assert load().jobs[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


@pytest.mark.parametrize("names", ["x05 x08 x10", "r01 e08"])
def test_queries_of_a_family(tmp_path, names):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=str(REPO), names=names)],
        cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable} | {k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")},
        capture_output=True, text=True, timeout=600,
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
