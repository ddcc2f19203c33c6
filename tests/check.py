"""Run registered queries against their check SQL: python tests/check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from pagetide.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(fn(spark, sf_dir), con, oracles[name]) or "ok"
            else:
                verdict = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as exc:  # report and go on with the next query
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:24s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
