"""Tables that grow by committed batches: what a batch writes counts once its marker is there, all of it at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommittedBatches:
    """Several tables under one folder that are appended together.

    Each table has a folder for each batch, and ``_commits/<batch>`` is made when all of them are
    written. Readers see committed batches only. Writing a batch that is committed does nothing, and
    one that failed half-way is written over, so a job may be run again under its batch id at any
    time. The rows of a batch are never read back to find out what is new.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, StructType]) -> None:
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _at(self, *parts: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def committed(self) -> list[int]:
        """Ids of the batches that count."""
        fs, path = self._at("_commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def is_committed(self, batch: int) -> bool:
        fs, path = self._at("_commits", batch)
        return fs.exists(path)

    def commit(self, batch: int, rows: dict[str, DataFrame]) -> bool:
        """Write all tables of a batch and then its marker; False if it was there already."""
        if self.is_committed(batch):
            return False
        for name, schema in self.tables.items():
            rows[name].select(*schema.names).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        fs, path = self._at("_commits", batch)
        fs.create(path, True).close()
        return True

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table's rows of the committed batches, or of those before one, with their batch."""
        schema = StructType([*self.tables[name].fields]).add("batch", "long")
        batches = [b for b in self.committed() if before is None or b < before]
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def sink(self, make: Callable[[DataFrame, int], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch: commits what ``make`` derives from a micro-batch, under its id."""

        def write(rows: DataFrame, batch: int) -> None:
            if not self.is_committed(batch):
                self.commit(batch, make(rows, batch))

        return write
