"""SparkSession construction for tests, the bench and local runs.

On a cluster the caller owns the session; the library only *reads* settings from it
(``spark.checkpoint.dir`` for staged tables, ``ledgerlens.broadcast.maxRows`` for the
broadcast bound).  Nothing here is needed for library use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def scale_conf(cpus: int = 8) -> dict[str, str]:
    """Settings used locally; the comments say what to change for a large cluster."""
    return {
        # AQE re-plans at every exchange: coalesces small partitions, splits skewed ones,
        # and turns a sort-merge join into a broadcast join when the *measured* side is small.
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # On a 1000-executor cluster: a few thousand partitions, AQE coalesces to ~128 MB each.
        "spark.sql.shuffle.partitions": str(max(2 * cpus, 8)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
        # No broadcast on optimizer *estimates*: a broadcast happens only for a side whose row
        # count was checked (plans.broadcast) or whose shuffle output AQE measured.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def local_session(cpus: int = 8, app: str = "ledgerlens", checkpoint_dir: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local[cpus] session for tests and the bench.

    ``spark.checkpoint.dir`` is set here only because a local run has none; a cluster names
    a shared folder there and this function is not used.
    """
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = scale_conf(cpus)
    conf["spark.driver.memory"] = "16g"
    conf["spark.checkpoint.dir"] = checkpoint_dir or tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    conf.update(extra or {})
    for k, v in os.environ.items():  # e.g. LEDGERLENS_CONF_spark.sql.shuffle.partitions=8
        if k.startswith("LEDGERLENS_CONF_"):
            conf[k[len("LEDGERLENS_CONF_"):]] = v
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
