"""Small files through Hadoop's FileContext, so that a database root may be any path Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import CorruptCatalog


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self._path("")).toString()
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        """The text of a file, or None if there is none."""
        try:
            stream = self.fs.open(self._path(name))
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Exception as e:
            if "ChecksumException" in str(e):
                raise CorruptCatalog(f"{name} is damaged") from e
            raise
        finally:
            stream.close()

    def _beside(self, name: str, text: str):
        """The text in a file beside the target, flushed to the device."""
        side = self._path(f"{name}.{uuid.uuid4().hex}.new")
        stream = self.fs.create(side, True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        return side

    def _rename(self, side, name: str, how) -> None:
        option = self.jvm.java.lang.reflect.Array.newInstance(how.getClass(), 1)
        option[0] = how
        self.context.rename(side, self._path(name), option)

    def replace(self, name: str, text: str) -> None:
        """Write beside the target and rename over it: readers see the old text or the new."""
        self._rename(self._beside(name, text), name, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def create(self, name: str, text: str) -> bool:
        """Write beside the target and rename, unless there is such a file: False then. Readers see nothing or all of it."""
        self.fs.mkdirs(self._path(name).getParent())
        side = self._beside(name, text)
        try:
            self._rename(side, name, self.jvm.org.apache.hadoop.fs.Options.Rename.NONE)
        except Exception as e:
            self.fs.delete(side, False)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def claim(self, name: str, text: str) -> bool:
        """Create the file; False if it is there already."""
        return self.create(name, text)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))
