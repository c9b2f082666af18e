"""Run every registered query against its oracle: ``python tests/check_all.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from sward.plans.registry import oracles, queries  # noqa: E402
from sward.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
texts = oracles()
for name, fn in queries().items():
    if names and name not in names:
        continue
    t = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in texts:
            ok, note = compare(df, con, texts[name])
        else:
            ok, note = True, f"{df.count()} rows, no oracle"
    except Exception as e:
        ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {note}", flush=True)
print(f"{bad} failed")
sys.exit(bool(bad))
