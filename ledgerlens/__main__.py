"""Command line: the two extracts and the per-user report set.

    python -m ledgerlens [--master URL] [--conf k=v ...] billing-extract --url JDBC_URL --promo PROMO_TABLE
        --out DIR [--csv DIR] [--start 12/04/2025 --end 21/04/2025 [--inclusive-end]]
        --partition pcpedc:numped:1:N:P --partition pcmov:numped:1:N:P
        (or --snapshot [--rows R] instead of --partition: one state of the source, partitions of R rows)
    python -m ledgerlens [...] demand-extract --url JDBC_URL --out DIR [--csv DIR] --partition pedido:num_ped:1:N:P
    python -m ledgerlens [...] reports --billing PATH --demand PATH [--format csv|parquet]
        [--user DIRETORIA] [--state CE] [--roster PATH] --out DIR [--display]

(with spark-submit, submit ``ledgerlens/__main__.py`` with the same arguments). The session
takes its settings from the environment or ``--master`` / ``--conf``; credentials are read by
``sources.jdbc.credentials`` (prefixes ``oracle`` and ``postgres``). A big table without a partitioning
is an error unless ``--single-task`` is given. Of the movements, only those of orders that the
campaign may let in are requested. Every output is published (``plans.publish``): a new version beside the old
one, all reports of a run in one version; ``folder`` in the printed line is where it is. A missing input of ``reports`` ends with code 2 and no report.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession


def _session(master: str | None, conf: list[str]) -> SparkSession:
    b = SparkSession.builder.appName("ledgerlens")
    if master:
        b = b.master(master)
    for kv in conf:
        k, _, v = kv.partition("=")
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerlens")
    p.add_argument("--master", default=None)
    p.add_argument("--conf", action="append", default=[], help="Spark setting key=value (repeatable)")
    sub = p.add_subparsers(dest="cmd", required=True)

    be = sub.add_parser("billing-extract")
    be.add_argument("--url", required=True)
    be.add_argument("--promo", required=True, help="Parquet/CSV table with a promo_code column")
    be.add_argument("--out", required=True)
    be.add_argument("--csv")
    be.add_argument("--start")
    be.add_argument("--end")
    be.add_argument("--inclusive-end", action="store_true", help="the last day counts whole")

    de = sub.add_parser("demand-extract")
    de.add_argument("--url", required=True)
    de.add_argument("--out", required=True)
    de.add_argument("--csv")

    for x in (be, de):
        x.add_argument("--partition", action="append", default=[], metavar="TABLE:COLUMN:LOWER:UPPER:PARTITIONS")
        x.add_argument("--snapshot", action="store_true", help="read one state of the source, with partitions that it counts itself")
        x.add_argument("--rows", type=int, default=2_000_000, help="rows of a partition, with --snapshot")
        x.add_argument("--single-task", action="store_true", help="read big tables in one task each")

    rp = sub.add_parser("reports")
    rp.add_argument("--billing", required=True)
    rp.add_argument("--demand", required=True)
    rp.add_argument("--format", default="csv", choices=["csv", "parquet"])
    rp.add_argument("--user", default="DIRETORIA")
    rp.add_argument("--state", default=None)
    rp.add_argument("--roster", default=None)
    rp.add_argument("--roster-decimal-comma", action="store_true")
    rp.add_argument("--out", required=True)
    rp.add_argument("--display", action="store_true")
    a = p.parse_args(argv)

    spark = _session(a.master, a.conf)
    if a.cmd == "billing-extract":
        from ledgerlens.operators.billing import CAMPAIGN_RULES, BillingRules
        from ledgerlens.operators.extracts import billing_extract
        from ledgerlens.sources import jdbc, snapshot
        rules = BillingRules(window_start=a.start or CAMPAIGN_RULES.window_start,
                             window_end=a.end or CAMPAIGN_RULES.window_end, end_inclusive_day=a.inclusive_end)
        promo = (spark.read.parquet(a.promo) if not a.promo.endswith(".csv")
                 else spark.read.option("header", True).csv(a.promo)).select("promo_code")
        if a.snapshot:
            with snapshot.Snapshot(spark, a.url, snapshot.ORACLE) as state:
                of_campaign = jdbc.campaign_movements(rules, at=state.dialect.table("", state.token))
                tables = snapshot.read_all(state, jdbc.ERP_TABLES, {"pcmov": of_campaign}, a.rows)
                print(json.dumps(billing_extract(tables, promo, a.out, rules, a.csv)))
            return 0
        part = jdbc.parse_partitioning(a.partition)
        jdbc.require_partitioning(jdbc.ERP_TABLES, part, a.single_task)
        part["pcmov"] = replace(part.get("pcmov", jdbc.JdbcTable("pcmov")), table=jdbc.campaign_movements(rules))
        tables = jdbc.read_tables(spark, a.url, jdbc.ERP_TABLES, "oracle", part)
        print(json.dumps(billing_extract(tables, promo, a.out, rules, a.csv)))
    elif a.cmd == "demand-extract":
        from ledgerlens.operators.extracts import demand_extract
        from ledgerlens.sources import jdbc, snapshot
        if a.snapshot:
            with snapshot.Snapshot(spark, a.url, snapshot.POSTGRES) as state:
                print(json.dumps(demand_extract(snapshot.read_all(state, jdbc.PORTAL_TABLES, rows=a.rows), a.out, a.csv)))
            return 0
        part = jdbc.parse_partitioning(a.partition)
        jdbc.require_partitioning(jdbc.PORTAL_TABLES, part, a.single_task)
        tables = jdbc.read_tables(spark, a.url, jdbc.PORTAL_TABLES, "postgres", part)
        print(json.dumps(demand_extract(tables, a.out, a.csv)))
    else:
        from ledgerlens.operators.report_set import report_set
        from ledgerlens.operators.scope import permitted_state
        from ledgerlens.operators.sinks import export_all
        from ledgerlens.sources.files import load_inputs, missing_paths, read_roster
        missing = missing_paths(spark, a.billing, a.demand, *[a.roster] * bool(a.roster))
        if missing:
            print(f"ledgerlens: no input at {' and '.join(missing)}; no report was written", file=sys.stderr)
            return 2
        billing, demand = load_inputs(spark, a.billing, a.demand, fmt=a.format)
        roster = read_roster(spark, a.roster, decimal_comma=a.roster_decimal_comma) if a.roster else None
        state = permitted_state(a.user, a.state)
        with report_set(billing, demand, state, roster=roster, display=a.display) as reports:
            written = export_all(reports, a.out, fmt="csv" if a.display else "parquet")
        print(json.dumps({"state": state, "reports": sorted(reports), "folder": written}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
