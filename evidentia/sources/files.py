"""Small files and renames on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """File operations of the driver through Hadoop: existence, listings, texts, renames that never overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _written(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def move(self, name: str, to: str, replace: bool = False) -> bool:
        """Rename; false if the target exists and isn't to be replaced."""
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE if replace else option.NONE
        self._fs.mkdirs(self._path(to).getParent())
        if not replace and self.exists(to):
            return False
        try:
            self._context.rename(self._path(name), self._path(to), options)
        except Exception:
            if replace or not self.exists(to):
                raise
            return False  # another writer was faster
        return True

    def put(self, name: str, text: str, draft: str, replace: bool = False) -> bool:
        """Write ``draft`` and move it into place; false if the name is taken and isn't to be replaced."""
        self._written(draft, text)
        moved = self.move(draft, name, replace)
        if not moved:
            self.delete(draft)
        return moved

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
