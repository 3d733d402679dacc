"""ledgerlens: sales reconciliation (ordered vs billed vs returned) as Spark DataFrame plans.

Layers:

* ``ledgerlens.functions`` - column expressions (key cleaning, text normalisation, money).
* ``ledgerlens.sources``   - readers: JDBC, CSV, Parquet, plus the test-table mapping.
* ``ledgerlens.operators`` - the user-level operators (billing, demand, scope, reconcile, reports, sinks).
* ``ledgerlens.plans``     - plan helpers: bounded broadcast, staging of shared inputs, the query catalog.
"""

__version__ = "0.1.0"

from ledgerlens.functions import clean_key, format_brl, norm_text  # noqa: E402
from ledgerlens.operators.billing import BillingRules, BillingTables, build_billing  # noqa: E402
from ledgerlens.operators.demand import build_demand  # noqa: E402
from ledgerlens.operators.reconcile import reconcile  # noqa: E402
from ledgerlens.operators.report_set import report_set  # noqa: E402
from ledgerlens.operators.scope import scope  # noqa: E402
from ledgerlens.operators.sinks import export  # noqa: E402
from ledgerlens.sources.files import load_inputs  # noqa: E402

__all__ = [
    "BillingRules", "BillingTables", "build_billing", "build_demand", "clean_key", "export",
    "format_brl", "load_inputs", "norm_text", "reconcile", "report_set", "scope",
]
