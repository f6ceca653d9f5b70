"""Tables and files written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="textward-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of rows that travel to Python at once. A worker's arrays are several times that.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Send batches of at most BATCH_BYTES to Python, unless the session says otherwise than Spark's default."""
    if spark.conf.get(_BATCH, "64m").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def free(names: list[str], wanted: str) -> str:
    """A column name like the wanted one that isn't taken."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class Scratch:
    """A folder of one run. Its tables cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        bounded(spark)
        self.spark, self.root, self.made = spark, f"{base(spark)}/textward/{what}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the written table."""
        self.made += 1
        path = self.path(f"{name}-{self.made}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        self.remove(df.kept_at)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
