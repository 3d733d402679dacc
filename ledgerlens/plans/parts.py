"""Shuffle partitions by the size of a job.

A session's ``spark.sql.shuffle.partitions`` is one number for small and large inputs; with it, a task of a large job
holds and spills ever more rows. ``enough_partitions`` raises it for the jobs that are run within, so that a task gets
``ledgerlens.shuffle.rows`` rows (default: 500,000), however large the input is. Where it does, AQE puts partitions
together up to 16 MB only, as the session's advisory size may be many times these rows. An aggregate's map-side phase
stays, which an explicit repartition would lose.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_ROWS = 500_000
#: AQE's advisory size in MB where partitions are raised.
TOGETHER_MB = 16
_ROWS_KEY, _PARTITIONS_KEY, _ADVISORY_KEY = "ledgerlens.shuffle.rows", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: By application: the session's own settings, and the partitions asked for just now.
_asked: dict[str, tuple[int, str, list[int]]] = {}
_lock = threading.Lock()


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows; the session's number at least."""
    each = int(spark.conf.get(_ROWS_KEY, None) or DEFAULT_ROWS)
    return max(int(spark.conf.get(_PARTITIONS_KEY)), -(-rows // each))


def _mb(size: str) -> float:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) * {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(unit, 1) / 2**20


def _set(spark: SparkSession, own: int, advisory: str, asked: list[int]) -> None:
    most = max([own, *asked])
    spark.conf.set(_PARTITIONS_KEY, str(most))
    spark.conf.set(_ADVISORY_KEY, f"{TOGETHER_MB}m" if most > own and _mb(advisory) > TOGETHER_MB else advisory)


@contextmanager
def enough_partitions(spark: SparkSession, rows: int) -> Iterator[int]:
    """Jobs run within shuffle to ``partitions_for(rows)`` partitions. DataFrames are planned when they are run, so one that
    is only made within, and run later, gets the session's number."""
    app, n = spark.conf.get("spark.app.id", "app"), partitions_for(spark, rows)
    with _lock:
        own, advisory, asked = _asked.setdefault(app, (int(spark.conf.get(_PARTITIONS_KEY)), spark.conf.get(_ADVISORY_KEY), []))
        asked.append(n)
        _set(spark, own, advisory, asked)
    try:
        yield n
    finally:
        with _lock:
            asked.remove(n)
            _set(spark, own, advisory, asked)
            if not asked:
                del _asked[app]
