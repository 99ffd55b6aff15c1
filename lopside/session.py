"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lopside") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A local session without that setting gets one, in a folder that goes when the program ends; on a cluster it
    must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="lopside-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used where one intermediate feeds several jobs or a loop would grow its
    lineage. The files outlive a lost executor, and unlike a checkpointed plan
    the table has its true size: after a few joins in a loop the size estimates
    carried along by checkpoints grow without bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lopside/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.pinned_at = path
    return table


def unpin(table: DataFrame) -> None:
    """Delete the files of a table that ``pin`` returned, once nothing that is still to run reads it; others stay."""
    path = getattr(table, "pinned_at", None)
    if path is not None:
        jvm = table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def parallelism(spark: SparkSession) -> int:
    """How many partitions a CPU-bound stage should be given."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, shuffle)
