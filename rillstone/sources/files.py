"""Files through Hadoop's API, so a store lives wherever Spark can write."""

from __future__ import annotations

import hashlib
import os
import uuid

from py4j.protocol import Py4JJavaError


class Files:
    def __init__(self, spark, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, name: str, data: bytes):
        """A file of its own beside ``name``."""
        part = self.path(f"{name}.part-{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(bytearray(data))
        out.close()
        return part

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file whole; False if it is there already.

        Of several writers one gets True.  On a local disk a hard link, on HDFS a rename that never overwrites decides; a store that has
        neither (an object store) needs one writer at a time, or a file system that rejects the rename itself.
        """
        part = self._write(name, data)
        try:
            if self.fs.getScheme() == "file":
                base = self.fs.makeQualified(self.path(name)).toUri().getPath()
                os.link(part.toUri().getPath(), base)
                self.fs.delete(part, False)
            else:
                fs = self.jvm.org.apache.hadoop.fs
                none = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.NONE.getClass(), 1)
                none[0] = fs.Options.Rename.NONE
                fs.FileContext.getFileContext(part.toUri(), self.conf).rename(part, self.path(name), none)
            return True
        except (FileExistsError, Py4JJavaError) as e:
            self.fs.delete(part, False)
            if isinstance(e, Py4JJavaError) and not self.fs.exists(self.path(name)):
                raise
            return False

    def replace(self, name: str, data: bytes) -> None:
        """Write a file whole, over an older one if there is one: a reader sees the old or the new bytes."""
        part = self._write(name, data)
        fs = self.jvm.org.apache.hadoop.fs
        over = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
        over[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(part.toUri(), self.conf).rename(part, self.path(name), over)

    def used(self) -> int:
        """Bytes below the root."""
        return self.fs.getContentSummary(self.path("")).getLength() if self.exists("") else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def tree(self, folder: str = "") -> list[str]:
        out, it = [], self.fs.listFiles(self.path(folder), True)
        base = self.fs.makeQualified(self.path("")).toUri().getPath()
        while it.hasNext():
            out.append(it.next().getPath().toUri().getPath()[len(base) :].lstrip("/"))
        return sorted(n for n in out if not n.rsplit("/", 1)[-1].endswith(".crc"))

    def copy(self, name: str, other: Files) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), other.fs, other.path(name), False, True, self.conf)

    def digest(self, name: str) -> str:
        return hashlib.sha256(self.read(name)).hexdigest()
