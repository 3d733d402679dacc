"""Helpers shared by the operators: packing of documents, staged tables, table reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.broadcast import is_bounded
from ledgerlens.plans.scratch import scratch_root
from ledgerlens.plans.ship import ship

#: A word: a run of anything but the six ASCII white-space characters (as bytes.split() cuts).
WORD = r"[^\x20\x09-\x0D]+"
#: A broadcast side may have at most so many rows (and bytes: see ``plans.broadcast``).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all input columns), ``id``, ``text`` and ``k``, a hash of both.

    (id, k) names a document: rows that repeat both id and text are one document to the
    operators (and each of them comes back); an id repeated with other text is another document.
    """
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")
                       ).withColumn("k", F.xxhash64("id", "text"))


_paths: dict[str, list[str]] = {}


def staged_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/llm/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back: cuts lineage, survives lost executors.
    The files stay until ``remove_staged``, as results may read them."""
    spark = df.sparkSession
    path = f"{staged_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_paths(spark: SparkSession) -> list[str]:
    """What this application has staged and not removed yet, in order."""
    return list(_paths.get(spark.sparkContext.applicationId, []))


def remove_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables (all of this application, if none are named): once the results that read them are written."""
    sc = spark.sparkContext
    for p in staged_paths(spark) if paths is None else paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _paths[sc.applicationId].remove(p)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles, whatever size Spark takes it for. Spark goes by the bytes of the files and by one
    element an array, so it would broadcast a table that an explode has grown many times, or one of long arrays."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after a measure of rows and bytes has shown that ``df`` is within both bounds; else a
    shuffle join, even if Spark takes ``df`` for small."""
    return F.broadcast(df) if is_bounded(df, max_rows) else shuffled(df)


def attach(base: DataFrame, found: DataFrame) -> DataFrame:
    """``base`` left-joined to per-document results keyed by (id, k), null ids included."""
    f = found.withColumnsRenamed({"id": "_fid", "k": "_fk"})
    return base.join(f, (F.col("k") == F.col("_fk")) & F.col("id").eqNullSafe(F.col("_fid")), "left").drop("_fid", "_fk")
