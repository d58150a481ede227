"""Access to the Parquet tables of one data directory."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: When the driver last collected its garbage for :func:`materialise`.
_collected = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; only the columns used are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Reads ``spark.checkpoint.dir`` from the session.  Only where it is unset, and
    driver and executors are one process (a local test session), a temporary folder
    is used, which goes with the process; on a cluster an unset folder raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import atexit
    import shutil
    import tempfile

    here = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, here, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{here}")
    return f"file://{here}"


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: what follows does not compute ``df`` again, and the written
    files survive the loss of executors.  They are removed by :func:`release`, or
    when the application ends.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/quern-{spark.sparkContext.applicationId}"
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, p = _path(spark, own)
    fs.deleteOnExit(p)
    # The shuffle files behind ``df`` are of no more use; Spark removes them when the driver collects its garbage.
    global _collected
    if time.monotonic() - _collected > 1:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what :func:`materialise` wrote; nothing that is still to run may read it."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many partitions as there are cores.

    For costly work on a table of few, small files, whose rows it moves once; a large
    table already has more partitions and is not moved.  The rows are the same.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
