"""JDBC sources: the billing ERP (Oracle) and the order portal (PostgreSQL).

Upstream, each extract is one SQL text executed inside the source database and fetched
whole into one process. Here every base table is its own JDBC DataFrame - Spark pushes the
column list and simple filters into the remote query - read in parallel by range on a
numeric key (``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``), and the
joins, aggregation and de-duplication run in Spark (``sources.erp`` maps the columns).

Credentials come from the environment or the Spark conf, never from code. No JDBC driver
ships here, so these readers are exercised only by option-building tests.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.billing import parse_moment


@dataclass(frozen=True)
class JdbcTable:
    table: str
    columns: tuple[str, ...] = ()
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    predicates: tuple[str, ...] = field(default=())


def credentials(spark: SparkSession, prefix: str) -> tuple[str | None, str | None]:
    """(user, password) from ``ledgerlens.jdbc.<prefix>.user|password`` in the Spark conf,
    else the environment variables ``<PREFIX>_USER`` / ``<PREFIX>_PASSWORD``."""
    user = spark.conf.get(f"ledgerlens.jdbc.{prefix}.user", None) or os.environ.get(f"{prefix.upper()}_USER")
    pwd = spark.conf.get(f"ledgerlens.jdbc.{prefix}.password", None) or os.environ.get(f"{prefix.upper()}_PASSWORD")
    return user, pwd


def jdbc_options(url: str, spec: JdbcTable, user: str | None, password: str | None,
                 driver: str | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    opts = {"url": url, "dbtable": spec.table, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver:
        opts["driver"] = driver
    if spec.partition_column and not spec.predicates:
        if None in (spec.lower_bound, spec.upper_bound, spec.num_partitions):
            raise ValueError("a partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        opts.update({
            "partitionColumn": spec.partition_column,
            "lowerBound": str(spec.lower_bound),
            "upperBound": str(spec.upper_bound),
            "numPartitions": str(spec.num_partitions),
        })
    return opts


def read_jdbc(spark: SparkSession, url: str, spec: JdbcTable, user: str | None = None,
              password: str | None = None, driver: str | None = None) -> DataFrame:
    """One JDBC DataFrame. ``spec.predicates`` (one WHERE clause per partition, e.g. one per
    month of order dates) takes precedence over range partitioning on a numeric column."""
    opts = jdbc_options(url, spec, user, password, driver)
    if spec.predicates:
        props = {k: v for k, v in opts.items() if k not in ("url", "dbtable")}
        df = spark.read.jdbc(url, spec.table, predicates=list(spec.predicates), properties=props)
    else:
        df = spark.read.format("jdbc").options(**opts).load()
    return df.select(*spec.columns) if spec.columns else df


# The source tables and the columns the extracts use.
ERP_TABLES = {
    "pcpedc": ("codfilial", "numped", "codcli", "vlatend", "data", "posicao", "tipofv",
               "origemped", "codemitente", "codpromocaomed"),
    "pcmov": ("numped", "codfornec", "codoper", "punit", "qt"),
    "pcclient": ("codcli", "codcliprinc", "cliente", "estent"),
    "pcfornec": ("codfornec", "fornecedor"),
}
BIG_TABLES = {"pcpedc", "pcmov", "pedido"}
PORTAL_TABLES = {
    "pedido": ("num_ped", "fornecedor_id", "cliente_id", "valor_total"),
    "fornecedor": ("id", "nome_fantasia"),
    "cliente": ("id", "cod_cli_princ", "nome_fantasia", "estado"),
}


def campaign_movements(rules, table: str = "pcmov", header: str = "pcpedc", at: str = "") -> str:
    """A ``dbtable`` that makes the source send only movements of orders that the rules may let in
    (the promotion table is not in the source: any promotion code counts). ``at`` names a snapshot behind both tables."""
    def quoted(values):
        return ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)

    def one_of(column, values):
        return [] if values is None else [f"p.{column} in ({quoted(values)})"]

    first, last = parse_moment(rules.window_start), parse_moment(rules.window_end)
    if rules.end_inclusive_day and last.time() == last.min.time():
        last, below = last + timedelta(days=1), "<"
    else:
        below = "<="
    window = [f"p.data >= timestamp '{first:%Y-%m-%d %H:%M:%S}'", f"p.data {below} timestamp '{last:%Y-%m-%d %H:%M:%S}'",
              *one_of("posicao", rules.statuses), *one_of("tipofv", rules.sale_types), *one_of("origemped", rules.origins),
              *one_of("codemitente", rules.issuers)]
    promo = ["p.codpromocaomed is not null", *one_of("posicao", rules.promo_statuses)]
    return (f"(select m.numped, m.codfornec, m.codoper, m.punit, m.qt from {table}{at} m where m.numped <> 0 and m.codfornec <> 0 "
            f"and exists (select 1 from {header}{at} p where p.numped = m.numped and (({' and '.join(window)}) or ({' and '.join(promo)})))) {table}")


def parse_partitioning(texts: list[str]) -> dict[str, JdbcTable]:
    """``TABLE:COLUMN:LOWER:UPPER:PARTITIONS`` each, to read specifications by table."""
    out = {}
    for t in texts:
        parts = t.split(":")
        if len(parts) != 5 or not all(p.lstrip("-").isdigit() for p in parts[2:]):
            raise ValueError(f"not TABLE:COLUMN:LOWER:UPPER:PARTITIONS: {t!r}")
        out[parts[0]] = JdbcTable(parts[0], partition_column=parts[1], lower_bound=int(parts[2]), upper_bound=int(parts[3]),
                                  num_partitions=int(parts[4]))
    return out


def require_partitioning(tables, partitioning: dict[str, JdbcTable], single_task: bool) -> None:
    """An error for big tables that one task would read whole, unless that is asked for."""
    bare = sorted(BIG_TABLES & set(tables) - set(partitioning))
    if bare and not single_task:
        raise ValueError(f"{', '.join(bare)}: give a partitioning (TABLE:COLUMN:LOWER:UPPER:PARTITIONS), or ask for a single-task read")


def read_tables(spark: SparkSession, url: str, tables: dict[str, tuple[str, ...]], prefix: str,
                partitioning: dict[str, JdbcTable] | None = None,
                driver: str | None = None) -> dict[str, DataFrame]:
    """One DataFrame per source table, pruned to the used columns; big tables partitioned by key."""
    user, pwd = credentials(spark, prefix)
    out = {}
    for name, cols in tables.items():
        spec = (partitioning or {}).get(name) or JdbcTable(table=name)
        spec = JdbcTable(table=spec.table, columns=cols, partition_column=spec.partition_column,
                         lower_bound=spec.lower_bound, upper_bound=spec.upper_bound,
                         num_partitions=spec.num_partitions, predicates=spec.predicates)
        out[name] = read_jdbc(spark, url, spec, user, pwd, driver)
    return out
