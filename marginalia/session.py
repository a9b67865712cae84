"""Session set-up and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Upper bound on rows shipped to every executor by an explicit broadcast.
BROADCAST_ROWS = 20_000
# Upper bound on the text in them.
BROADCAST_BYTES = 64 << 20


def build_session(app_name: str = "marginalia", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marginalia-package-"), "marginalia.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("marginalia", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's setting. Only in a single JVM, where it is unset, one of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc.getCheckpointDir()
    if root is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="marginalia-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of any executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For tables several branches of a plan consume: later scans keep column pruning and
    filter pushdown, which a row-wise checkpoint loses.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "marginalia", f"{label}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables needed only until a job's result is written, below one folder that goes when the block ends.

    ``write`` is :func:`materialize` with an end; ``drop`` removes tables whose readers are done. What outlives the block
    must have been written elsewhere. After an exception the folder goes too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}
        self.path = os.path.join(checkpoint_root(spark), "marginalia", f"scratch-{uuid.uuid4().hex}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self._delete(self.path)
        release(self.spark)

    def write(self, df: DataFrame, label: str = "table", row_group: int | None = None) -> DataFrame:
        """``row_group`` bounds the bytes a task holds before it writes them, for wide rows."""
        path = f"{self.path}/{label}-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
        self.held.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            for path in self.held.pop(label, []):
                self._delete(path)
        release(self.spark)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs: Spark removes their shuffle files once the driver has collected its references to them."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than cores; large scans pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROWS, text: str | None = None, max_bytes: int = BROADCAST_BYTES) -> int | None:
    """Row count when it is at most ``limit`` and column ``text`` holds at most ``max_bytes`` in all; None otherwise."""
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    n, held = df.limit(limit + 1).agg(F.count(F.lit(1)), size).first()
    return n if n <= limit and (held or 0) <= max_bytes else None


def of_few(df: DataFrame, key: str, ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in the only column of ``ids``.

    Up to ``limit`` different values become a list that Spark carries below splits, generators and computed columns to the
    scan, so that only these rows are worked out; more of them are a semi join.
    """
    name = ids.columns[0]
    some = ids.filter(F.col(name).isNotNull()).distinct()
    few = [r[0] for r in some.limit(limit + 1).collect()]
    if len(few) > limit:
        return df.join(some.withColumnRenamed(name, key), key, "left_semi")
    return df.filter(F.col(key).isin(few))
