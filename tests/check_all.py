"""Compare every query at a scale: python tests/check_all.py FOLDER [NAME ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from opsframe import get_session  # noqa: E402
from opsframe.plans.catalog import QUERIES  # noqa: E402
from opsframe.plans.oracles import ORACLES  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problems = differences(df, ORACLES[name], con) if name in ORACLES else [f"no sql, rows {df.count()}"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - started:.1f}s", *problems, sep="\n    ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
