"""Write the physical plans of the heavy builders to docs/plans.md (run: python tools/dump_plans.py [sf_dir])."""

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.plans import catalog as C  # noqa: E402
from ledgerlens.operators import reconcile as R  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = local_session(8, checkpoint_dir=tempfile.mkdtemp(prefix="ledgerlens-plans-"))
items = [
    ("q01 order suppliers", C.q01_order_suppliers(spark, SF)),
    ("q03 billing lines", C.q03_billing_lines(spark, SF)),
    ("q06 unified billing (before staging)", C.unified_billing(spark, SF)),
    ("q07 demand (before staging)", C.demand(spark, SF)),
    ("q11 client reconciliation (before staging)",
     R.reconcile_client(C.staged_billing(spark, SF), C.staged_demand(spark, SF))),
    ("q24 client roster", C.q24_client_roster(spark, SF)),
]
out = ["# Physical plans (static, before AQE re-planning)", "",
       f"Generated by `tools/dump_plans.py` on `{os.path.basename(SF.rstrip('/'))}` with the local session "
       "settings of `ledgerlens.session` (estimate-based broadcast off; broadcasts come from checked bounds).", ""]
for title, df in items:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = "\n".join(line[:220] for line in buf.getvalue().strip().splitlines())
    out += [f"## {title}", "", "```", plan, "```", ""]
with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md"), "w") as f:
    f.write("\n".join(out))
spark.stop()
