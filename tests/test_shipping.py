"""The package reaches Python workers of a session started anywhere."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
CHILD = """
import sys
sys.path.insert(0, {root!r})
from gridloom.session import build_session
from gridloom.plans import registry
spark = build_session("child", cpus=2, **{{"spark.driver.memory": "2g"}})
print("rows", registry.queries()["p1_found"](spark, {data!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_a_query_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CHILD.format(root=ROOT, data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.split("rows ")[1]) > 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from gridloom.storage import shared_dir

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(fake(master))
    assert shared_dir(fake("local[2]"))
