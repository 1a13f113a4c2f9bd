"""Small files and folders on whatever file system Hadoop knows: local, HDFS, an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder. Names are relative to it; every call goes to the file system of its address."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._of(self.root).getFileSystem(self._conf)

    def _of(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _at(self, name: str):
        return self._of(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str = "") -> str:
        """The full address, as a reader takes it."""
        return str(self._fs.makeQualified(self._at(name)).toString())

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def stamp(self, name: str = "") -> list[tuple[str, int, int]]:
        """(name, size, time of change) of a file or of the files in a folder."""
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a small file in place as a whole, over an older one: a reader sees the old or the new text."""
        tmp = self._at(f"_{name.replace('/', '-')}.tmp")
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        target = self._fs.makeQualified(self._at(name))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self._fs.makeQualified(tmp), target, how)

    def move(self, old: str, new: str) -> None:
        """Rename, or raise: a move that another try has made already is fine."""
        if self.exists(new):
            if self.exists(old):
                raise OSError(f"{self.path(new)} is there already")
            return
        if not (self.exists(old) and self._fs.rename(self._at(old), self._at(new))):
            raise OSError(f"can't move {self.path(old)} to {self.path(new)}")

    def delete_at_exit(self) -> None:
        """Delete the folder when the application ends."""
        self._fs.deleteOnExit(self._at(""))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
