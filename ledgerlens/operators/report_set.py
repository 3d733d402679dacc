"""Every report a user sees, from (billing, demand) and the user's scope.

``report_set`` scopes both inputs and stages them, and the client and supplier tables made of them,
in a run folder of its own under ``spark.checkpoint.dir``; all reports are made of the staged
tables. So the reports of one call agree with each other even if the inputs are written anew, a new
call sees new inputs, and tables that were handed out stay readable until ``close()``. A scoped user
gets no table that names another state or counts its clients. Nothing is collected: the caller
decides which to show. ``client_counts`` (state, clients) replaces the computed clients-per-state
table by a maintained one. ``display=True`` formats money as currency text and renames columns to the
display headers, the last step before showing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import reports as P
from ledgerlens.operators.reconcile import branch_and_state, reconcile, split_summaries, totals
from ledgerlens.operators.scope import scope, states_offered
from ledgerlens.plans.stage import Run

# The roster's state aliases (spelled-out names and cities -> state codes).
ROSTER_STATE_MAP = {
    "BAIA": "BA", "CEARA": "CE", "IMPERATRIZ": "MA",
    "PERNAB": "PE", "SAOLUIS": "MA", "TERESINA": "PI",
}


class Reports(dict):
    """Reports by name; ``close()`` (or leaving a ``with`` block) removes the staged tables behind them."""

    def __init__(self, run: Run):
        super().__init__()
        self._run = run

    def close(self) -> None:
        self._run.remove()

    def __enter__(self) -> Reports:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _money_cols(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def report_set(billing: DataFrame, demand: DataFrame, state: str | None = None,
               roster: DataFrame | None = None, state_map: dict[str, str] | None = None,
               dedupe_orders: bool = False, display: bool = False,
               client_counts: DataFrame | None = None) -> Reports:
    run = Run(billing.sparkSession)
    b, d = scope(billing, demand, state)
    b, d = run.keep(b, "billing"), run.keep(d, "demand")
    rec = reconcile(b, d, dedupe_orders=dedupe_orders)
    client, supplier = run.keep(rec.client, "client"), run.keep(rec.supplier, "supplier")
    if "branch_id" in b.columns and "state" in b.columns:
        branches, states = split_summaries(run.keep(branch_and_state(b), "branch_state"))
    else:
        branches, states = rec.branch, rec.state
    tables = {"totals": totals(b, d), "clients_in_scope": P.clients_in_scope(b), "clients_per_state": P.clients_per_state(b, client_counts, state),
              "client": client, "supplier": supplier, "branch": branches, "state": states}
    out = Reports(run)
    out.update(reports_of(tables, states_offered(b, state), state, roster, state_map, display))
    return out


def reports_of(tables: dict[str, DataFrame], states: DataFrame, state: str | None, roster: DataFrame | None = None,
               state_map: dict[str, str] | None = None, display: bool = False) -> dict[str, DataFrame]:
    """The reports that are shown, of the tables of one scope (``report_set``, ``state_reports``)."""
    client, supplier = tables["client"], tables["supplier"]
    out = {
        "states": states,
        "totals": tables["totals"],
        "clients_in_scope": tables["clients_in_scope"],
        "clients_per_state": tables["clients_per_state"],
        "top_clients": P.top_clients(client),
        "top_suppliers": P.top_suppliers(supplier),
        "branches": P.branch_report(tables["branch"]),
        "states_summary": P.state_report(tables["state"]),
        "client_detail": P.client_detail(client),
        "client_returns": P.client_returns(client),
        "supplier_detail": P.supplier_detail(supplier),
        "supplier_returns": P.supplier_returns(supplier),
    }
    out["clients_shown"] = P.clients_shown(out["clients_per_state"], state)
    if roster is not None:
        out["roster"] = P.client_roster(roster, state, ROSTER_STATE_MAP if state_map is None else state_map)
    if display:
        money = ["ordered", "billed", "returned", "flow_diff", "net_billed", "total_spent"]
        labels = {
            "top_clients": {"client_name": "Cliente", "net_billed": "Receita Líquida"},
            "top_suppliers": {"supplier_name": "Fornecedor", "supplier_key": "CNPJ", "billed": "Valor Faturado"},
            "branches": P.BRANCH_LABELS, "states_summary": P.STATE_LABELS,
            "client_detail": P.CLIENT_LABELS, "supplier_detail": P.SUPPLIER_LABELS,
            "client_returns": {"client_name": "CLIENTE", "returned": "Valor Devolvido"},
            "supplier_returns": {"supplier_name": "Fornecedor", "returned": "Valor Devolvido"},
        }
        for name, lab in labels.items():
            df = out[name].select(*lab)  # the displayed columns only, in display order
            out[name] = P.for_display(df, lab, _money_cols(df, money))
        if "roster" in out:
            out["roster"] = P.for_display(out["roster"], P.ROSTER_LABELS, ["total_spent"])
        out["clients_shown"] = out["clients_shown"].select(F.lit(P.clients_label(state)).alias("label"), "clients")
    return out


def is_empty_scope(report: dict[str, DataFrame]) -> bool:
    """The report edge's 'no data for this state' test (one small job)."""
    return report["client_detail"].select(F.lit(1)).isEmpty()
