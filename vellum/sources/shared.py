"""Files in a folder that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a local session gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-vellum-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


class Folder:
    """A folder of small files and of data: list, read, put once, remove."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        """Names of what is in the folder, or in one below it; none if it isn't there. Hidden and unfinished files are left out."""
        at = self._at(below)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if n[0] not in "._")

    def read(self, name: str) -> str:
        jvm, stream = self.spark.sparkContext._jvm, self._fs.open(self._at(name))
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Make a file that is there whole or not at all; FileExistsError if the name is taken, also by another writer just now."""
        jvm, half = self.spark.sparkContext._jvm, self._at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(half, False)
        stream.write(text.encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(half.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(half, self._at(name), no_options)
        except Exception as e:
            self._fs.delete(half, False)
            if self._fs.exists(self._at(name)):
                raise FileExistsError(f"{self.path}/{name}") from e
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a real copy, of which every reader sees the same rows."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
