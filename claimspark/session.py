"""Session construction and the shared scratch location.

Cluster jobs get their session from the platform; ``get_session`` is for
tests, the bench and local runs.  Intermediate data goes to the folder named
by ``spark.checkpoint.dir`` and nowhere else.  Only a session on a local
master may do without the setting: it gets a private folder, since driver and
executors are one process there.  On a cluster an unset folder is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this library relies on.  AQE re-plans joins from
# runtime sizes (so dimension joins only become broadcasts when the measured
# side is small), splits skewed shuffle partitions and coalesces tiny ones.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # ~128 MB per task after a shuffle and per scan split: partitions that fit
    # in executor memory without spilling at any scale factor.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "claimspark",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if (master or "").startswith("local"):
        # Local runs only: keep the default catalog's folder out of the working
        # directory (clusters configure their own warehouse).
        conf.setdefault("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="claimspark-warehouse-"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine (``local[...]`` masters)."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; raises on a cluster without one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="claimspark-ckpt-")  # local master, as in tests
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/claimspark/{name}-{uuid.uuid4().hex[:12]}"


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_dir`` gave, once its table is no longer read."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/claimspark/"):
        raise ValueError(f"not a folder of this session: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: what reads
    it scans the table, and a lost executor recomputes nothing upstream."""
    path = shared_dir(df.sparkSession, name)
    for open_scratch in _SCRATCH[-1:]:
        open_scratch.paths.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver's garbage collector has found that
    nothing reads them any more, which a driver with little to do may not see for the
    whole job.  To be called after a large table is written.  The scheduler holds on to
    the last job, so one without a shuffle goes first."""
    spark.range(1, numPartitions=1).count()
    spark.sparkContext._jvm.System.gc()


_SCRATCH: list[scratch] = []


class scratch:
    """Deletes, on leaving, every table that ``stored`` wrote inside the block.

    For jobs that end in a written result: what they stored on the way is then read
    by nobody.  ``kept`` writes a table that outlives the block (its folder is
    ``last``); an enclosing block owns it.  A block that fails deletes its tables, too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.last = spark, [], None

    def __enter__(self) -> scratch:
        _SCRATCH.append(self)
        return self

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = self.last = shared_dir(self.spark, name)
        place = _SCRATCH.index(self)
        for outer in _SCRATCH[max(0, place - 1):place]:
            outer.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        _SCRATCH.remove(self)
        for path in self.paths:
            delete_dir(self.spark, path)


#: A lookup table of at most so many rows is broadcast, a longer one joined by a shuffle.
BROADCAST_ROWS = 100_000


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``df`` with a per-key table.  The table is written once and counted:
    up to ``BROADCAST_ROWS`` rows it is broadcast, else the join shuffles and
    adaptive execution splits hot keys.  The result is the same either way."""
    table = stored(table, "lookup")
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, keys, how)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy.

    Used where a small intermediate table (per-value counts, per-score
    totals) is read several times: the upstream plan runs once, the lineage
    is cut, and a lost executor does not force recomputation from the source.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
