"""Python workers get the package from the session, not from the working directory."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from pagetide.session import build_session
spark = build_session("ship", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
for name in ("t_lines", "t_edit_order", "st_dup_jobs", "st_job_state"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
print("shipped")
"""


def test_workers_need_no_copy(sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf_dir)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=600)
    assert "shipped" in done.stdout, done.stderr[-2000:]
