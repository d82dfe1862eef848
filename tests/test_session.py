"""The shared folder: where it is, and that nothing stays in it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import os, sys
sys.path.insert(0, sys.argv[1])
from gridledger.session import ensure_checkpoint_dir, local_session, new_work_path, shared_root
import __spark_entry__ as entry
spark = local_session("2", "area", **{"spark.ui.showConsoleProgress": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
ensure_checkpoint_dir(spark)
assert spark.range(5).checkpoint().count() == 5
assert entry.queries()["s02_staged_archives"](spark, "/root/testdata/sf0.001").count() > 0
area = os.path.dirname(new_work_path(spark, "x"))
assert os.listdir(area)
print("AREA", area)
"""


def test_without_settings_a_local_session_works_and_cleans_up(folder):
    """An empty configuration folder: no checkpoint setting, and the package only on the driver's path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": folder, "TMPDIR": folder}
    done = subprocess.run([sys.executable, "-c", PROGRAM, ROOT], env=env, cwd=folder, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    area = done.stdout.split("AREA")[1].strip()
    assert area.startswith(folder) and not os.path.exists(area)
