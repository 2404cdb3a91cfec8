"""Session settings the operators rely on.

Day boundaries are computed in the session time zone, so every entry point
pins it to UTC.  The remaining settings are the scale-relevant defaults: AQE
(runtime coalescing, skew-join splitting, broadcast conversion based on the
*measured* shuffle size) and partition sizing.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone) and for scale (AQE).
SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    # A selective filter on one join side becomes a bloom filter on the other side's
    # scan (e.g. orders of a date range -> lineitems), applied before the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (safe to call repeatedly)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors with ``addPyFile``, once an application."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    with tempfile.NamedTemporaryFile(prefix="pulse-", suffix=".zip", delete=False) as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(f.name)
    _SHIPPED.add(spark.sparkContext.applicationId)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_test_checkpoint_dir(spark: SparkSession) -> str:
    """For local sessions only: set a scratch checkpoint folder when none is set.

    On a cluster a temporary folder is another one on every machine: there the folder must be named.
    """
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    d = tempfile.mkdtemp(prefix="pulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pulse") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df):
    """Cut the lineage of an input that a multi-pass algorithm reads several times.

    With a shared checkpoint folder (``spark.checkpoint.dir``) the data is written
    there (``checkpoint``), so passes survive lost executors without recomputing
    the upstream joins; without one it is persisted (memory, spilling to disk).
    """
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    out = df.persist()
    out.count()
    return out


def new_folder(spark: SparkSession) -> str:
    """A path below the checkpoint folder that nothing uses yet."""
    base = checkpoint_dir(spark) or ensure_test_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/pulse-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df, parts: int | None = None):
    """``df`` written once as Parquet below the checkpoint folder and read back.

    What is read back no longer depends on how the rows were dealt when they were computed, so row numbers and
    partition numbers in it hold for good. ``parts``: files at most, for tables known to be small.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class materialized:
    """``with materialized(df) as m:`` -- ``m`` is checkpointed or persisted for the passes
    inside the block; a persisted copy is released on exit (results built from it
    re-plan from lineage), so long sessions do not accumulate cached blocks."""

    def __init__(self, df):
        self.df = df
        self.out = None

    def __enter__(self):
        self.out = materialize(self.df)
        return self.out

    def __exit__(self, *exc):
        if self.out is not None and not checkpoint_dir(self.out.sparkSession):
            self.out.unpersist(blocking=False)
        return False
