"""Session settings and the shared folder for data that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession

# Runtime SQL settings every job relies on. Static settings (memory, cores,
# shuffle partitions) belong to whoever starts the session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join input even when the next operator then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every partition of one join side is measured to be
    # this small at run time; larger sides keep the sort merge join.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Large stream state stays on disk and is checkpointed in changes.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Merge the sessions of a busy key before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tiffin", **settings: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach, named by ``spark.checkpoint.dir``.

    A single-JVM session without that setting gets a folder of its own, set once in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tiffin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def pin(df):
    """Checkpoint ``df`` in the shared folder, so later plans read fixed data."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df):
    """``df`` written as compressed Parquet files in the shared folder and read back; smaller than a checkpoint of many rows."""
    path = f"{shared_dir(df.sparkSession)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# While a job with a Scratch runs.
LEAN_SETTINGS = {
    # Shuffle files go with the query that made them, not when the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


class Scratch:
    """What one job writes and reads back along its way: Parquet files in the shared folder, gone when the job ends.

    Calling it keeps a table. ``LEAN_SETTINGS`` hold until the end of the job, for all that it writes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}"
        self.parts: list[str] = []

    def __enter__(self) -> Scratch:
        self.before = {key: self.spark.conf.get(key, None) for key in LEAN_SETTINGS}
        for key, value in LEAN_SETTINGS.items():
            self.spark.conf.set(key, value)
        return self

    def __exit__(self, *_) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        self._delete(self.folder)

    def __call__(self, df):
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.parts.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_unread(self, *tables) -> None:
        """Delete what was kept and none of these tables reads."""
        read = {unquote(file).rsplit("/", 2)[-2] for table in tables for file in table.inputFiles()}
        for path in [p for p in self.parts if p.rsplit("/", 1)[-1] not in read]:
            self.parts.remove(path)
            self._delete(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
