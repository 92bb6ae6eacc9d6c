"""Run every registered query against its SQL twin: python tests/check_all.py [folder] [name part ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import __spark_entry__ as e
from airloom.session import local_session
from tests.compare import duck, mismatch

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark, con, sqls = local_session(), duck(folder), e.oracle_sql()
bad = []
for name, q in e.queries().items():
    if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
        continue
    t = time.time()
    try:
        if name in sqls:
            df = q(spark, folder)
            msg = mismatch(df, con, sqls[name])
            n = ""
        else:
            n, msg = f" rows={q(spark, folder).count()} (no twin)", None
    except Exception as x:  # noqa: BLE001
        n, msg = "", f"{type(x).__name__} {str(x)[:600]}"
        if len(sys.argv) > 2:
            traceback.print_exc()
    print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - t:6.2f}s {name}{n} {msg or ''}", flush=True)
    if msg:
        bad.append(name)
missing = set(sqls) - set(e.queries())
print("FAILED", bad, "SQL without query", missing)
