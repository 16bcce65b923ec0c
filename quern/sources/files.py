"""Files of the warehouse through Hadoop's file systems, so that any shared store will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._sc, self.root = spark.sparkContext, root.rstrip("/")
        self._make = self._sc._jvm.org.apache.hadoop.fs.Path
        self._system = self._make(self.root).getFileSystem(self._sc._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def names(self, name: str = "") -> list[str]:
        target = self._make(self.path(name))
        return sorted(x.getPath().getName() for x in self._system.listStatus(target)) if self._system.exists(target) else []

    def read(self, name: str) -> str:
        stream = self._system.open(self._make(self.path(name)))
        try:
            return self._sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a whole new file or none; False if the name is taken, also by a writer of the same moment.

        Each writer has a draft of its own. Locally a hard link gives the draft its name, elsewhere a
        rename that does not overwrite; both fail at the store itself if the name exists.
        """
        target, draft = self._make(self.path(name)), self._make(self.path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}.draft"))
        self._system.mkdirs(target.getParent())
        stream = self._system.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._system.getScheme() == "file":
                own = lambda x: self._sc._jvm.java.nio.file.Path.of(x.toUri().getPath(), self._none(self._sc._jvm.java.lang.String))
                self._sc._jvm.java.nio.file.Files.createLink(own(target), own(draft))
            else:
                hadoop = self._sc._jvm.org.apache.hadoop.fs
                context = hadoop.FileContext.getFileContext(target.toUri(), self._sc._jsc.hadoopConfiguration())
                context.rename(draft, target, self._none(getattr(hadoop, "Options$Rename")))
            return True
        except Py4JJavaError as error:
            if not self._system.exists(target):
                raise error
            return False
        finally:
            self._system.delete(draft, False)

    def _none(self, kind):
        """No further arguments of a Java method that takes any number of them."""
        return self._sc._gateway.new_array(kind, 0)

    def modified(self, name: str) -> float:
        """When a file or folder last changed, in seconds."""
        return self._system.getFileStatus(self._make(self.path(name))).getModificationTime() / 1000

    def size(self, name: str) -> int:
        """Bytes of all files in a folder."""
        return self._system.getContentSummary(self._make(self.path(name))).getLength()

    def exists(self, name: str) -> bool:
        return self._system.exists(self._make(self.path(name)))

    def delete(self, name: str) -> None:
        self._system.delete(self._make(self.path(name)), True)

    def make_folder(self, name: str = "") -> None:
        self._system.mkdirs(self._make(self.path(name)))
