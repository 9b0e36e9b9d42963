"""Session helpers: where intermediate tables go, and how lineage is cut.

Intermediate results that several later stages read are written once as parquet
below the folder named by ``spark.checkpoint.dir`` (shared by all executors), so a
lost executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
#: Intermediate tables on disk, by application.
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, read from the session.

    Only a ``local`` master may fall back to a folder of this machine; on a cluster an
    unset ``spark.checkpoint.dir`` is an error rather than a silently local path.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="gleaner-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], True)
    return f"file://{_LOCAL_DIRS[0]}"


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan with simple projections, in at least as many partitions as there are cores.

    A single small file would otherwise keep costly per-row work on one core; an input that
    has enough splits of its own is left as it is, so nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files behind a table that :func:`materialize` returned; nothing may read it any more."""
    _remove(df.sparkSession, df._gleaner_path)


def drop_all(spark: SparkSession) -> int:
    """Remove every intermediate table of this session, once the results made from them have been read; returns how many."""
    paths = list(_written.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _remove(spark, path)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data layout, one parquet file or folder per name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
