"""Small files of a shared file system, through Hadoop's interface."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small text files whose creation is atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._place().getFileSystem(self._conf)

    def _place(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        place = self._place(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._place(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Writes a new file; False, and no change, where one of that name is there already.

        The content is written aside and renamed, so nobody reads half of it, and of two
        who create one name at a time one succeeds.
        """
        aside = f"_{name.replace('/', '_')}-{self._jvm.java.util.UUID.randomUUID()}"
        stream = self._fs.create(self._place(aside), False)
        stream.write(bytearray(content, "utf-8"))
        stream.close()
        self._fs.mkdirs(self._place(name).getParent())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._place(aside), self._place(name), options)
        except Py4JJavaError:
            self._fs.delete(self._place(aside), False)
            if not self._fs.exists(self._place(name)):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._place(name), True)

    def modified(self, name: str) -> float:
        """Seconds since the epoch, by the file system's clock."""
        return self._fs.getFileStatus(self._place(name)).getModificationTime() / 1000
