"""Staging: write a shared intermediate once as Parquet under ``spark.checkpoint.dir``.

The unified billing table and the demand table feed a dozen reports. Re-deriving them per
report re-plans (and re-runs) every scan, join and shuffle; staging them cuts the lineage, so
a lost executor costs a re-read of Parquet instead of a recomputation, and later reports get
column pruning and filter pushdown on the staged files.

Every staged table gets a path of its own that is written once and never overwritten, so a table
that was handed out stays readable. A caller's staging belongs to its ``Run`` (one folder, removed
with ``Run.remove``). The catalog's shared tables are kept per key, and a key holds the signature
of the input files (path, length, modification time): changed inputs are another key. They belong to the
application's run, as do the headers of single builds; ``forget`` removes them all.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.parts import enough_partitions

_staged: dict[tuple[str, str], DataFrame] = {}
_runs: dict[str, Run] = {}
_building: dict[tuple[str, str], threading.Lock] = {}
_lock = threading.Lock()


def checkpoint_root(spark: SparkSession) -> str | None:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            root = None
    return root or None


def stage_key(name: str, *parts: object) -> str:
    digest = hashlib.sha1(repr(parts).encode()).hexdigest()[:16]
    return f"{name}-{digest}"


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and modification time of the data files at ``path``, also in folders within; hidden ones are left out."""
    conf, root = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = root.getFileSystem(conf), []
    todo = [root]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.getPath().getName()[:1] in ("_", "."):
                continue
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def file_signature(spark: SparkSession, *paths: str) -> str:
    """A digest of the files at the paths: names, lengths, modification times."""
    return hashlib.sha256(repr([f for p in paths for f in list_files(spark, p)]).encode()).hexdigest()


class Run:
    """One run's folder of staged tables under the session's shared folder (see ``plans.scratch``)."""

    def __init__(self, spark: SparkSession):
        from ledgerlens.plans.scratch import scratch_root
        self.spark = spark
        self.folder = f"{scratch_root(spark).rstrip('/')}/ledgerlens-run/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read back with its known schema (no footer inference)."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the folder; tables of this run can't be read afterwards."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def app_run(spark: SparkSession) -> Run:
    """The run of this application: for tables that are read as long as results of it are; ``forget`` removes it."""
    app = spark.conf.get("spark.app.id", "app")
    with _lock:
        return _runs.setdefault(app, Run(spark))


def stage(spark: SparkSession, key: str, build: Callable[[], DataFrame], rows: Callable[[], int] | None = None) -> DataFrame:
    """The staged table ``key`` of this application; ``build()`` is written first if there is none yet, with shuffle
    partitions for ``rows()`` rows (``plans.parts``)."""
    at = (spark.conf.get("spark.app.id", "app"), key)
    with _lock:
        own = _building.setdefault(at, threading.Lock())
    with own:
        with _lock:
            df = _staged.get(at)
        if df is None:
            with enough_partitions(spark, rows() if rows else 0):
                df = app_run(spark).keep(build(), key)
            with _lock:
                _staged[at] = df
    return df


def forget(spark: SparkSession) -> None:
    """Drop what this application has staged, files too; results that read them must have been written."""
    app = spark.conf.get("spark.app.id", "app")
    with _lock:
        for k in [k for k in _staged if k[0] == app]:
            del _staged[k]
        run = _runs.pop(app, None)
    if run is not None:
        run.remove()
