"""Small tables carried from one micro-batch to the next, keyed by batch id.

Batch n reads what batch n - 1 saved and overwrites its own. A batch that runs
again after a failure finds the same input state, so it repeats its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirlog.session import folder_exists, remove_folder

RETAINED = "spark.sql.streaming.minBatchesToRetain"


class BatchState:
    """Tables are kept for as many batches as Spark can go back to."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/batch={batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The table saved by the batch before, or None for the first."""
        if batch_id == 0:
            return None
        return spark.read.parquet(self._path(batch_id - 1))

    def save(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Save a batch's table and give it back as read."""
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(self._path(batch_id))
        remove_folder(spark, self._path(batch_id - int(spark.conf.get(RETAINED, "100")) - 1))
        return spark.read.schema(df.schema).parquet(self._path(batch_id))

    def once(self, df: DataFrame, batch_id: int) -> DataFrame:
        """The batch's table as first saved: what a repeated batch finds is not written again."""
        spark = df.sparkSession
        if folder_exists(spark, f"{self._path(batch_id)}/_SUCCESS"):
            return spark.read.schema(df.schema).parquet(self._path(batch_id))
        return self.save(df, batch_id)
