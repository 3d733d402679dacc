"""Partitioned JDBC reads of one state of a source, with bounds that the source itself gives.

A single statement sees one state of the database. A read in many partitions, and of several tables, is many statements:
each must name the same state, or an order may come without its movements. So a read begins by asking the source for a
snapshot, and every partition's query is bound to it:

* Oracle: the system change number; each table is read ``as of scn`` that number (flashback query).
* PostgreSQL: a transaction on the driver exports its snapshot and stays open; each partition's session imports it
  (``sessionInitStatement``) before it reads. ``close`` ends that transaction.

Bounds aren't given by hand. One query per table, at the snapshot, counts rows in ``BUCKETS`` equal ranges of the key;
neighbouring ranges are joined until a partition has its share of rows, so gaps and dense stretches of the key give
partitions of one size. A range that alone holds more, a hot key, is split further by a hash of the row's address. Rows
without a key go to a partition of their own. The partitions' conditions exclude each other and cover all rows.

No database can be reached here: texts, options and conditions are tested (the conditions on an in-process engine), the
live read is not.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.jdbc import JdbcTable, credentials, jdbc_options

#: Ranges that the source counts for a table, rows of a partition, partitions of a table at most.
BUCKETS, ROWS, MOST = 4096, 2_000_000, 20_000

Ask = Callable[[str], list[tuple]]


@dataclass(frozen=True)
class Dialect:
    """How a source names a snapshot. ``token_sql`` asks for it; ``at`` follows a table's name; ``init`` opens a partition's
    session; ``part`` is a number from 0 to n - 1 of a row's address."""

    name: str
    token_sql: str | None
    at: str = ""
    init: tuple[str, ...] = ()
    part: str = ""
    holds_transaction: bool = False

    def table(self, name: str, token: str | None) -> str:
        return name + (self.at.format(token=_checked(token)) if token else "")

    def session(self, token: str | None) -> str | None:
        return "; ".join(self.init).format(token=_checked(token)) if token and self.init else None


def _checked(token: str) -> str:
    """A snapshot's name as the sources write it: anything else doesn't get into a statement."""
    if not token or not all(c.isalnum() or c == "-" for c in token):
        raise ValueError(f"not a snapshot's name: {token!r}")
    return token


ORACLE = Dialect("oracle", "select to_char(dbms_flashback.get_system_change_number) from dual", at=" as of scn {token}",
                 part="ora_hash(rowid, {last})")
POSTGRES = Dialect("postgres", "select pg_export_snapshot()",
                   init=("set transaction isolation level repeatable read", "set transaction snapshot '{token}'"),
                   part="((hashtext(ctid::text) & 2147483647) % {n})", holds_transaction=True)
DIALECTS = {d.name: d for d in (ORACLE, POSTGRES)}


def bounds_sql(table: str, key: str) -> str:
    return f"select min({key}), max({key}), count(*), count({key}) from {table}"


def histogram_sql(table: str, key: str, least: int, most: int, buckets: int = BUCKETS) -> str:
    """Rows in equal ranges of the key: number of the range, rows, smallest and largest key in it."""
    width = max(1, -(-(most - least + 1) // buckets))
    return (f"select floor(({key} - {least}) / {width}), count(*), min({key}), max({key}) from {table} "
            f"where {key} is not null group by floor(({key} - {least}) / {width})")


def conditions(key: str, ranges: list[tuple[int, int, int, int]], n_null: int, rows: int, part: str = "") -> list[str]:
    """One condition a partition. ``ranges``: (number, rows, smallest, largest key), as the histogram gives them."""
    out, held, first = [], 0, None
    ranges = sorted(ranges)

    def close(last: int) -> None:
        nonlocal held, first
        if first is not None:
            out.append(f"{key} >= {first} and {key} <= {last}")
        held, first = 0, None

    last = None
    for _, n, low, high in ranges:
        if held and held + n > rows:
            close(last)
        if n > rows and part and low == high:  # one hot key: no range can split it
            pieces = math.ceil(n / rows)
            out += [f"{key} = {low} and {part.format(n=pieces, last=pieces - 1)} = {i}" for i in range(pieces)]
            continue
        first = low if first is None else first
        held, last = held + n, high
    close(last)
    if n_null:
        out.append(f"{key} is null")
    return out


def plan(ask: Ask, table: str, key: str, rows: int = ROWS, part: str = "", buckets: int = BUCKETS) -> list[str]:
    """The conditions of a table's partitions, from two or three queries of a few rows at the source.

    Ranges with more rows than a partition's share are counted again in finer ranges, until they fit or are one key."""
    least, most, n, n_key = ask(bounds_sql(table, key))[0]
    rows = max(rows, -(-int(n) // MOST))
    if not n_key:
        return conditions(key, [], int(n), rows, part)
    todo, done = [(int(least), int(most), table)], []
    while todo:
        low, high, of = todo.pop()
        for b, m, a, z in ask(histogram_sql(of, key, low, high, buckets)):
            a, z, m = int(a), int(z), int(m)
            if m > rows and a < z:
                todo.append((a, z, f"(select * from {table} where {key} >= {a} and {key} <= {z}) t"))
            else:
                done.append((a, m, a, z))
    return conditions(key, done, int(n) - int(n_key), rows, part)


class Snapshot:
    """One state of a source, for any number of tables. Use as a context, or ``close``.

    ``ask`` runs a query on the driver's connection and returns its rows; by default that is a JDBC connection of this
    object's own, which PostgreSQL needs anyway."""

    def __init__(self, spark: SparkSession, url: str, dialect: Dialect, driver: str | None = None, ask: Ask | None = None):
        self.spark, self.url, self.dialect, self.driver, self._connection = spark, url, dialect, driver, None
        self.user, self.password = credentials(spark, dialect.name)
        self.ask = ask or self._query
        self.token = str(self.ask(dialect.token_sql)[0][0]) if dialect.token_sql else None

    def _query(self, sql: str) -> list[tuple]:
        if self._connection is None:
            jvm = self.spark.sparkContext._jvm
            props = jvm.java.util.Properties()
            for k, v in (("user", self.user), ("password", self.password)):
                if v is not None:
                    props.setProperty(k, v)
            if self.driver:
                jvm.java.lang.Class.forName(self.driver)
            self._connection = jvm.java.sql.DriverManager.getConnection(self.url, props)
            if self.dialect.holds_transaction:
                self._connection.setAutoCommit(False)
                self._connection.setTransactionIsolation(4)  # repeatable read
        statement = self._connection.createStatement()
        try:
            found, out = statement.executeQuery(sql), []
            width = found.getMetaData().getColumnCount()
            while found.next():
                out.append(tuple(found.getString(i + 1) for i in range(width)))
            return out
        finally:
            statement.close()

    def options(self, name: str, columns: tuple[str, ...], source: str | None = None) -> dict[str, str]:
        """The reader's options; ``source`` is a query to read instead of the table itself."""
        text = source or f"(select {', '.join(columns)} from {self.dialect.table(name, self.token)}) {name}"
        opts = jdbc_options(self.url, JdbcTable(text), self.user, self.password, self.driver)
        session = self.dialect.session(self.token)
        return opts | ({"sessionInitStatement": session} if session else {})

    def conditions(self, name: str, key: str, rows: int = ROWS, source: str | None = None) -> list[str]:
        # A row's address exists in a table, not in a query over tables.
        return plan(self.ask, source or self.dialect.table(name, self.token), key, rows, "" if source else self.dialect.part)

    def read(self, name: str, columns: tuple[str, ...], key: str | None = None, rows: int = ROWS, source: str | None = None) -> DataFrame:
        """A table (or ``source``) of this state: by ranges of ``key``, or in one task without a key."""
        opts = self.options(name, columns, source)
        if key is None:
            return self.spark.read.format("jdbc").options(**opts).load().select(*columns)
        properties = {k: v for k, v in opts.items() if k not in ("url", "dbtable")}
        where = self.conditions(name, key, rows, source) or ["1 = 0"]
        return self.spark.read.jdbc(self.url, opts["dbtable"], predicates=where, properties=properties).select(*columns)

    def close(self) -> None:
        """End the driver's connection, and with it the transaction that holds an exported snapshot."""
        if self._connection is not None:
            self._connection.close()
            self._connection = None

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


#: The keys that the big tables are read by.
KEYS = {"pcpedc": "numped", "pcmov": "numped", "pedido": "num_ped"}


def read_all(snapshot: Snapshot, tables: dict[str, tuple[str, ...]], sources: dict[str, str] | None = None, rows: int = ROWS) -> dict[str, DataFrame]:
    """All tables of one state. Use them before the snapshot is closed."""
    return {name: snapshot.read(name, columns, KEYS.get(name), rows, (sources or {}).get(name)) for name, columns in tables.items()}
