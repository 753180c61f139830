"""Files in any store that Spark reaches: names, whole small files, exclusive creation."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder, through Hadoop's FileSystem; ``name`` is relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.files = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        """The names of what a folder holds, in order; none where it doesn't exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.files.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.files.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if another one has that name already.

        The text goes to a name of its own first and is renamed, so that no reader meets half a file; the empty claim beside it decides
        between writers where a store's rename would overwrite.
        """
        claim, draft = f"{name}.claim", f"{name}.draft"
        try:
            self.files.create(self._path(claim), False).close()
        except Exception as e:
            if self.exists(claim):
                return False
            raise e
        if self.exists(name):
            return False
        self.replace(draft, text)
        return bool(self.files.rename(self._path(draft), self._path(name)))

    def replace(self, name: str, text: str) -> None:
        out = self.files.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str = "") -> None:
        self.files.delete(self._path(name), True)

    def move(self, name: str, to: str) -> bool:
        return bool(self.files.rename(self._path(name), self._path(to)))
