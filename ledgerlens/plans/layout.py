"""Co-located tables: fact tables written once in buckets of the key they are joined and grouped on.

A table of a ``Layout`` is a bucketed Parquet table in the session's catalog. Two of them with the same key and the same
number of buckets are joined, and each is grouped by its key (or the key and more columns), without an exchange: the
hash of the key has already put rows where they belong. A refresh that builds several tables from the same facts
pays the exchange once, when the layout is written, instead of once for each join and aggregate.

A bucket is read by one task, so the rows of one key must be few. ``write`` leaves that to the caller, who sums up
rows first where a key can be hot (``operators.billing.colocate``, ``operators.demand.colocate``). Buckets should hold
some 128 MB to 512 MB: ``ledgerlens.layout.buckets`` (default: ``spark.sql.shuffle.partitions``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.stage import Run

_BUCKETS_KEY = "ledgerlens.layout.buckets"


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get(_BUCKETS_KEY, None) or spark.conf.get("spark.sql.shuffle.partitions"))


class Layout:
    """Bucketed tables in one folder under the session's shared folder. Use as a context, or call ``remove``."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or bucket_count(spark)
        self.run, self.tables = Run(spark), []

    def write(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` in buckets of ``key``, one file each, read back as a table of the catalog."""
        table = f"ledgerlens_{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        # The same hash deals rows to tasks and to buckets, so each task writes one file.
        (df.repartition(self.buckets, F.col(key)).write.bucketBy(self.buckets, key).sortBy(key).format("parquet")
         .option("path", f"{self.run.folder}/{name}").saveAsTable(table))
        return self.spark.table(table)

    def remove(self) -> None:
        """Drop the tables and delete their files."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
        self.run.remove()

    def __enter__(self) -> Layout:
        return self

    def __exit__(self, *exc) -> None:
        self.remove()
