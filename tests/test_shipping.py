"""Started from another folder without any path: workers get the package, and the work folder can be cleared."""

import os
import subprocess
import sys

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from tallyforge.session import checkpoint_root, clear_work, local_session
spark = local_session(2, 2)
assert entry.queries()["F1_indel_ratio"](spark, {data!r}).count() > 0
work = os.path.join(checkpoint_root(spark), spark.sparkContext.applicationId)
assert os.path.isdir(work)
clear_work(spark)
assert not os.path.exists(work)
spark.stop()
print("done")
"""


def test_from_another_folder(tmp_path, tiny):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, data=tiny)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
