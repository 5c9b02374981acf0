"""Developer loop: python tests/check.py [name-substring ...] compares queries with their SQL."""

from __future__ import annotations

import sys
import time
import warnings
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
warnings.filterwarnings("ignore")

from siftmill.plans.registry import load_all  # noqa: E402
from siftmill.session import build_session  # noqa: E402
from tests import oracle  # noqa: E402


def main() -> int:
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = oracle.sf("0.01")
    con = oracle.connect(sf_dir)
    wanted = sys.argv[1:]
    bad = 0
    for name, q in load_all().items():
        if wanted and not any(w in name or w in q.build.__module__ for w in wanted):
            continue
        start = time.time()
        try:
            got = q.build(spark, sf_dir).toPandas()
            mid = time.time()
            verdict = "rows-only" if q.sql is None else oracle.compare(got, con.execute(q.sql).df())
        except Exception as exc:  # noqa: BLE001
            got, mid, verdict = [], time.time(), "ERROR " + str(exc).split("JVM stacktrace")[0][:1500]
        ok = verdict in (None, "rows-only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} rows={len(got)} spark={mid-start:.1f}s sql={time.time()-mid:.1f}s {verdict or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
