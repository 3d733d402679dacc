"""Incremental refresh: a changed hand-off file replaces its share of the sums; all other files are not read again.

Reports need sums, smallest names and distinct keys of the billing and of the demand, and all of these can be taken of
sums by key and name just as well as of raw rows. So each input file keeps a share: its rows summed up by every key and
name column that a report looks at. A refresh lists the input files; files whose signature (path, length, modification
time) has a share are not opened; the others are read in one job and summed up by file. ``billing`` and ``demand`` of a
refresh are the shares of the files that are there now, with the inputs' columns (without the order id): ``reconcile``,
``report_set`` and the scopes take them in place of the inputs and give what a full run gives.

Shares and the list of which folder holds whose are one publication (``plans.publish``): a refresh that fails changes
nothing, and readers of the shares before go on. Shares of files that are gone are removed with the versions that used
them; where they lie in more than ``FOLDERS`` folders they are written together.

Money that is counted once an order (``dedupe_orders``) needs the order id and thus a full run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from ledgerlens.plans import publish as P
from ledgerlens.plans.broadcast import broadcast_if_bounded
from ledgerlens.plans.parts import enough_partitions
from ledgerlens.plans.stage import list_files
from ledgerlens.schemas import BILLING_FILE_SCHEMA, DEMAND_FILE_SCHEMA
from ledgerlens.sources.csv_records import file_key, file_name
from ledgerlens.sources.files import conform_billing, conform_demand, read_billing_csv, read_demand_csv

#: Folders that shares may lie in before they are written together.
FOLDERS = 16
#: Bytes of a row in an input file, about: the rows of files that are read decide the number of shuffle partitions.
ROW_BYTES = {"csv": 64, "parquet": 16}


@dataclass(frozen=True)
class Side:
    """One of the two inputs: its schema, and the columns that are summed up; all others but the order id are keys."""

    name: str
    schema: StructType
    sums: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.sums and c != "order_id"]

    def share_schema(self) -> StructType:
        fields = {f.name: f.dataType for f in self.schema.fields}
        wide = {c: DecimalType(28, 2) if isinstance(fields[c], DecimalType) else fields[c] for c in self.sums}
        return StructType([*[StructField(c, fields[c]) for c in self.keys], *[StructField(c, t) for c, t in wide.items()]])

    def shares(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column ``sig``, summed up by it and the keys."""
        sums = [F.sum(c).cast(self.share_schema()[c].dataType).alias(c) for c in self.sums]
        return rows.groupBy("sig", *self.keys).agg(*sums)


SIDES = (Side("billing", BILLING_FILE_SCHEMA, ("billed", "returned")), Side("demand", DEMAND_FILE_SCHEMA, ("ordered", "order_count")))


@dataclass
class Refreshed:
    billing: DataFrame
    demand: DataFrame
    #: The files that were read, by input.
    scanned: dict[str, list[str]] = field(default_factory=dict)


def _signatures(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Signature to path and length of every input file."""
    return {hashlib.sha256(repr(f).encode()).hexdigest()[:32]: f[:2] for f in list_files(spark, P.resolve(spark, path))}


def _read(spark: SparkSession, side: Side, paths: list[str], fmt: str) -> DataFrame:
    if fmt == "csv":
        return (read_billing_csv if side.name == "billing" else read_demand_csv)(spark, paths, "_file")
    rows = spark.read.parquet(*paths).select("*", file_name().alias("_file"))
    return (conform_billing if side.name == "billing" else conform_demand)(rows)


def _shares(spark: SparkSession, root: str, side: Side, folders: dict[str, str]) -> DataFrame:
    """The shares with these signatures (signature to folder)."""
    schema = StructType([*side.share_schema().fields, StructField("sig", StringType())])
    if not folders:
        return spark.createDataFrame([], schema)
    parts = None
    for folder in sorted(set(folders.values())):
        own = [s for s, f in folders.items() if f == folder]
        part = spark.read.schema(schema).parquet(f"{root}/{folder}/{side.name}").where(F.col("sig").isin(own))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def refresh(spark: SparkSession, billing_path: str, demand_path: str, root: str, fmt: str = "csv") -> Refreshed:
    """Bring the shares under ``root`` up to date with the files at both paths; see the module."""
    root = root.rstrip("/")
    old = (P.current(spark, root) or {}).get("shares", {})
    folder, shares, scanned = P.new_folder(), {}, {}
    try:
        for side, path in zip(SIDES, (billing_path, demand_path)):
            there = _signatures(spark, path)
            known = {s: f for s, f in old.get(side.name, {}).items() if s in there}
            new = {s: p for s, (p, _) in there.items() if s not in known}
            rows, made = sum(there[s][1] for s in new) // ROW_BYTES[fmt], None
            if new:
                names = spark.createDataFrame([(file_key(p), s) for s, p in new.items()], "_file string, sig string")
                made = side.shares(_read(spark, side, list(new.values()), fmt).join(broadcast_if_bounded(names), "_file"))
            if len(set(known.values())) >= FOLDERS:
                before = _shares(spark, root, side, known)
                made, known = before if made is None else made.unionByName(before), dict.fromkeys(known, folder)
                rows += before.count()
            if made is not None:
                with enough_partitions(spark, rows):
                    made.hint("rebalance", "sig").write.partitionBy("sig").parquet(f"{root}/{folder}/{side.name}")
            shares[side.name], scanned[side.name] = known | dict.fromkeys(new, folder), sorted(new.values())
    except BaseException:
        P._Files(spark, root).delete(f"{root}/{folder}")
        raise
    if shares != old:
        P.commit(spark, root, folder, shares=shares)
        P.prune(spark, root, used=lambda m: {m["folder"], *(f for x in m["shares"].values() for f in x.values())})
    out = [_shares(spark, root, side, shares[side.name]).drop("sig") for side in SIDES]
    return Refreshed(*out, scanned)
