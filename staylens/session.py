"""Session helpers: a local session for tests/bench and the shared checkpoint dir."""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "staylens") -> SparkSession:
    """A local-mode session configured the way the library expects to run.

    On a cluster the session is created by the platform; the library only reads
    settings from it (see :func:`checkpoint_dir`).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_DIRS: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """True for a local-mode session (tests, bench): one machine, one filesystem."""
    try:
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        master = spark.conf.get("spark.master", "")
    return str(master).startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the platform to shared storage (an error
    otherwise).  Only a local-mode session without one (tests, the bench) gets a
    temporary folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(a machine-local temporary folder is unusable on a cluster)")
        current = tempfile.mkdtemp(prefix="staylens-ckpt-")
        _OWN_DIRS.add(current)
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
        pass
    return current


def has_shared_checkpoint_dir(spark: SparkSession) -> bool:
    """True when the platform (not this library) named a checkpoint folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    return bool(current) and current not in _OWN_DIRS


_SCRATCH: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables.

    Results may read such tables, so they stay until :func:`remove_scratch`."""
    path = os.path.join(checkpoint_dir(spark), name)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def remove_scratch(spark: SparkSession, but: tuple[str, ...] = ()) -> list[str]:
    """Remove what this application has written below :func:`scratch_path`, at its end or
    when no result that reads it is needed any more; paths that hold one of ``but`` stay.
    Returns the removed paths."""
    gone = []
    for path in sorted(_SCRATCH.get(spark.sparkContext.applicationId, ())):
        if any(part in path for part in but):
            continue
        fs, place = file_system(spark, path)
        if fs.exists(place):
            fs.delete(place, True)
            gone.append(path)
        _SCRATCH[spark.sparkContext.applicationId].discard(path)
    return gone


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per context (as ``--py-files`` would);
    the archive is made on the driver and Spark distributes it."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="staylens-code-"), name)
    sc.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _SHIPPED.add(sc)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it: any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of the files under ``paths``, local or remote; a missing path counts 0."""
    total = 0
    for p in paths:
        fs, place = file_system(spark, p)
        if fs.exists(place):
            total += fs.getContentSummary(place).getLength()
    return total


def tune_for_input(spark: SparkSession, n_bytes: int, partition_bytes: int = 128 << 20,
                   expansion: float = 4.0) -> int:
    """Size shuffles and scans for an input of ``n_bytes`` (compressed Parquet).

    Initial shuffle partitions = expanded input / ``partition_bytes`` (never fewer
    than the cluster's cores); AQE then coalesces small ones toward the same
    advisory size and splits skewed ones.  Scan splits use ``partition_bytes``.
    Call it explicitly (bench, jobs); the library never changes a session by itself.
    """
    import math
    n = max(spark.sparkContext.defaultParallelism,
            int(math.ceil(n_bytes * expansion / partition_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(partition_bytes))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(partition_bytes))
    return n
