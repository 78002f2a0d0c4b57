"""Tables and paths in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a folder of its own, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/rudderql-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return what reads it; lineage ends at the files."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_all(spark: SparkSession) -> None:
    """Remove all tables that this application has written here; what reads them fails from then on."""
    root = shared_dir(spark)
    SharedFolder(spark, root).remove(f"rudderql-{spark.sparkContext.applicationId}")


class SharedFolder:
    """A folder of any file system that Spark can write, with names that only one writer can take."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def there(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def place(self, staged: str, final: str) -> bool:
        """Rename ``staged`` to ``final`` unless that is taken; then ``staged`` is removed. On a store whose rename overwrites, writers need a lock."""
        if not self.there(final) and self._fs.rename(self._at(staged), self._at(final)):
            nested = f"{final}/{staged.rpartition('/')[2]}"  # where rename moves into a folder that has just come
            if not self.there(nested):
                return True
            self.remove(nested)
        self.remove(staged)
        return False
