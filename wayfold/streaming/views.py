"""A live view of streams: the last row of each session, renewed at every trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

#: Milliseconds between two states of a live view, and of one that follows a place.
LIVE_MS, FOLLOW_MS = 200, 1500


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Whole versions of the view in ``folder``, by the batches that wrote them."""
    path, system = _path(spark, folder)
    if not system.exists(path):
        return []
    found = [s.getPath() for s in system.listStatus(path)]
    whole = [p.getName() for p in found if p.getName().startswith("v=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name[2:]) for name in whole)


def read_view(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest whole version, or None before the first."""
    known = versions(spark, folder)
    return spark.read.parquet(f"{folder}/v={known[-1]}") if known else None


def live_view(stream: DataFrame, folder: str, keys: list[str], order: list[str], every_ms: int = LIVE_MS) -> DataStreamWriter:
    """Keeps the last row (by ``order``) of each session of ``stream``, and how many there were
    (``n_rows``), in ``folder``; not yet started.

    Each trigger joins its rows to the version before and writes a version of its own under the
    batch's number, so a batch that is run again after a failure writes the same again. Readers
    take the latest whole version; older ones than the last two go. A version has one row a
    session.
    """
    values = [c for c in stream.columns if c not in keys]

    def renew(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, folder) if v < number]
        rows = batch.withColumn("n_rows", F.lit(1).cast("long"))
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v={before[-1]}"))
        last = F.max_by(F.struct(*values), F.struct(*order)).alias("r")
        made = rows.groupBy(*keys).agg(last, F.sum("n_rows").alias("n_rows"))
        made.select(*keys, "r.*", "n_rows").write.mode("overwrite").parquet(f"{folder}/v={number}")
        path, system = _path(spark, folder)
        for old in before[:-1]:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"v={old}"), True)

    return stream.writeStream.foreachBatch(renew).trigger(processingTime=f"{every_ms} milliseconds")
