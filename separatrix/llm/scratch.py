"""Tables between the steps of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from separatrix.storage import fresh_path


class Scratch:
    """Writes tables to the shared folder and deletes them when they are not needed any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back. A former table of that name goes, once it has been read."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return back

    def own(self, path: str, name: str) -> str:
        """A path that something else writes to, to be deleted by that name."""
        self.paths[name] = path
        return path

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
