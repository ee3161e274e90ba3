"""Run queries against their oracles from the command line: ``python tests/check.py [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import oracle  # noqa: E402

from partsight import plans  # noqa: E402
from partsight.session import local_session  # noqa: E402


def main() -> None:
    names = sys.argv[1:] or list(plans.queries())
    spark, con = local_session(cpus=8), oracle.connect()
    sqls = plans.oracle_sql()
    for name in names:
        start = time.time()
        try:
            df = plans.queries()[name](spark, oracle.SF_DIR)
            if name in sqls:
                diff = oracle.compare(df, con, sqls[name])
                note = "ok" if diff is None else f"DIFF {diff}"
            else:
                rows = df.collect()
                note = f"rows {len(rows)} {str(rows[0])[:300] if rows else ''}"
            if name in sqls and diff is None:
                note += f" {con.execute('SELECT count(*) FROM (' + sqls[name] + ')').fetchone()[0]}"
        except Exception as exc:  # noqa: BLE001
            note = f"ERROR {type(exc).__name__} {str(exc)[:700]}"
        print(f"{name} {time.time() - start:.1f}s {note}", flush=True)


if __name__ == "__main__":
    main()
