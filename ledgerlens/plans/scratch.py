"""Where written intermediates go: the session's ``spark.checkpoint.dir``.

On a cluster that setting names a shared folder and is required for anything this library
writes on its own account. Only a local-mode session without the setting gets a private
temporary folder (as tests do); a cluster session without it is an error.
"""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import SparkSession

from ledgerlens.plans.stage import checkpoint_root

_local_roots: dict[str, str] = {}
_lock = threading.Lock()


def scratch_root(spark: SparkSession) -> str:
    root = checkpoint_root(spark)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: ledgerlens writes intermediates there")
    app = spark.conf.get("spark.app.id", "app")
    with _lock:
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="ledgerlens-local-")
        return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.conf.get("spark.app.id", "app")
    return f"{scratch_root(spark)}/ledgerlens-out/{app}/{name}"
