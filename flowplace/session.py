"""Session set-up and the one place where intermediate results are made durable."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20  # bytes of an Arrow batch on its way to Python, as small_batches has it
CHECKPOINT_CONF = "spark.checkpoint.dir"
ZONE_CONF = "spark.sql.session.timeZone"

# Settings a job of this package wants; all are ordinary user-level Spark settings.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "flowplace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def suited(spark: SparkSession) -> SparkSession:
    """``spark`` if it works in UTC, which results depend on; else a session beside it that does.

    The caller's own settings are never changed.
    """
    if spark.conf.get(ZONE_CONF) in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        return spark
    own = spark.newSession()
    own.conf.set(ZONE_CONF, "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session beside the caller's whose Arrow batches hold about BATCH bytes, for Python steps over long texts.

    A batch is held by the JVM and by the Python worker, and its buffers grow by doubling; by default it has 10,000 rows of any
    length up to 64 MB. The caller's own settings are never changed; those set at run time come along.
    """
    spark = df.sparkSession
    own = spark.newSession()
    known = own.conf.getAll
    for key, value in spark.conf.getAll.items():
        if known.get(key) != value:
            own.conf.set(key, value)
    own.conf.set(BATCH_CONF, str(BATCH))
    name = f"flowplace_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    out = own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}")
    spark.catalog.dropGlobalTempView(name)
    return out


def expire(spark: SparkSession, older_than_secs: float) -> int:
    """Delete this package's intermediate tables that nobody has written for so long; returns their number.

    They are named by nothing but the DataFrames that read them, so only a time tells when they
    are done with: choose one longer than the longest job.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/flowplace")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    before = (time.time() - older_than_secs) * 1_000
    old = [s.getPath() for s in files.listStatus(root) if s.getModificationTime() < before]
    for path in old:
        files.delete(path, True)
    return len(old)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A session in a single process without that setting gets a folder of its own; wherever there
    are executors the setting is required.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="flowplace-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/flowplace/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage, survives lost executors, and gives the optimizer exact sizes,
    so later joins choose broadcast or shuffle on facts.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of an intermediate table that nothing reads any more."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if path.getParent().getName() == "flowplace":  # one that new_path named
            path.getFileSystem(conf).delete(path, True)
