"""Session helpers: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "folioflow", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset
    and no checkpoint folder was chosen, in a local session as in tests, a
    temporary one is made, and removed at exit. On a cluster, whose machines
    don't share one, that raises RuntimeError.
    """
    jsc = spark.sparkContext._jsc.sc()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if configured is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            configured = tempfile.mkdtemp(prefix="folioflow-ckpt-")
            atexit.register(shutil.rmtree, configured, True)
        spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here.

    The copy is on shared storage, so the loss of executors doesn't matter.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Kept:
    """Tables of an iteration, written to the shared folder and read back.

    Unlike a checkpoint, a table read back has the size of its files for its
    statistics; those of a checkpoint stem from its plan, and over many rounds of
    joins the product of sizes grows into numbers that fill the driver's memory.
    ``drop`` removes a table that is not needed any more; what is left goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self._remove, self.folder)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._remove(self.paths.pop(name))

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None and self.spark.sparkContext._jsc is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_within(small: DataFrame, limit: int) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows.

    Beyond that the planner is left to choose a shuffle join. The count stops
    after ``limit + 1`` rows.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small

