"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that already exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weirlog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where nothing is named and Spark runs
    on one machine; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weirlog-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str, below: str | None = None) -> str:
    """A fresh path below the shared folder, or the one that is given; nothing is created there yet."""
    return f"{below or shared_folder(spark)}/weirlog-{label}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so lost executors do no harm."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_listed(spark: SparkSession, path: str) -> None:
    """Remove a folder by its path as Spark lists it: escaped. It must have been there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.delete(target, True) and system.exists(target):
        raise OSError(f"could not remove {path}")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled to write a table is of no use once it is written, and goes then."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Tables written to the shared folder, or another, to be read several times, then removed."""

    def __init__(self, spark: SparkSession, below: str | None = None):
        self.spark = spark
        self.below = below
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def folder(self, label: str) -> str:
        """A fresh path that goes with the others."""
        self.folders.append(new_folder(self.spark, label, self.below))
        return self.folders[-1]

    def table(self, df: DataFrame, label: str) -> DataFrame:
        folder = self.folder(label)
        with shuffles_removed(self.spark):
            df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def __exit__(self, *_) -> None:
        for folder in self.folders:
            remove_folder(self.spark, folder)
