"""Small files and folders through Hadoop's file system, so that a store works wherever Spark reads and writes."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

#: Where intermediate files go when the session names no shared folder (local runs and tests).
LOCAL_FALLBACK = "/tmp/checkpoints"


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        #: The class, looked up once: each lookup asks the JVM for every part of its name.
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _p(self, name: str):
        return self._path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def names(self, name: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file whole or not at all; False if there is one of that name."""
        if self.exists(name):
            return False
        temp = self._p(f"_tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._p(name).getParent())
        done = self._fs.rename(temp, self._p(name))
        if not done:
            self._fs.delete(temp, False)
        return done

    def rename(self, old: str, new: str) -> None:
        """Moves a file or folder to a name that is free; raises if it did not, for then what was written is not there."""
        self._fs.mkdirs(self._p(new).getParent())
        # A folder that is renamed to an existing one would end up inside it.
        if self.exists(new) or not self._fs.rename(self._p(old), self._p(new)):
            raise OSError(f"{self.path(old)} could not be renamed to {self.path(new)}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self._fs.getFileStatus(self._p(name)).getModificationTime() / 1000

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._p(name)).getLength()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of ``setCheckpointDir``; only where both are unset, a local one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        path = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(path)
        return shared_dir(spark)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
