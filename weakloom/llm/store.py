"""Tables written to the shared folder and read back, to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weakloom.session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``; it is computed once, here."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables of one job that are deleted when the next ones have been written, and with them the shuffle files they were made from."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this job that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        # Spark deletes shuffle files once nothing in the driver refers to them; it need not wait for the next full collection.
        jvm.System.gc()
