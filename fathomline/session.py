"""Session helpers shared by the library, the benches and the tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fathomline") -> SparkSession:
    """A local session with the settings the tests and benches use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; in a local session without it (tests), a folder of our own.

    On a cluster a machine's own folder would be lost with it, so a session there without the setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="fathomline-checkpoint-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of rows that are sent to Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Send wide rows (texts, blocks of vectors) to Python in batches of some MB, however many rows that is.

    By rows alone, 10,000 at once, a batch grows with the rows' width and with a task's rows. This sets the session's option,
    unless the user has: plans read it when they run.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; works for any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
