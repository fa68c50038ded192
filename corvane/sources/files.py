"""Small files on any file system that Spark reaches, through Hadoop's own client."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


#: Seconds after which a lock counts as left behind by a writer that died.
LEASE_S = 30.0


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.gateway = spark.sparkContext._gateway
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.fs.mkdirs(self.path(""))

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file that must not be there yet; False if it is. The name appears with its whole content, in one step
        of the file system: a hard link, or a rename that does not overwrite. A writer that dies leaves only a file that
        nothing names. Where neither exists, a lock with a lease stands in."""
        held = f"_{uuid.uuid4().hex}"
        if self.exists(name):
            return False
        self.put(held, text)
        try:
            scheme = self.fs.getUri().getScheme()
            if scheme == "file" and (done := self._linked(held, name)) is not None:
                return done
            if scheme in ("hdfs", "viewfs"):
                return self._renamed(held, name)
            return self._leased(held, name)
        finally:
            self.delete(held)

    def _linked(self, held: str, name: str) -> bool | None:
        """None: this disk has no links."""
        at = lambda x: self.jvm.java.io.File(self.fs.makeQualified(self.path(x)).toUri().getPath()).toPath()
        try:
            self.jvm.java.nio.file.Files.createLink(at(name), at(held))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            if "UnsupportedOperation" in str(e) or "FileSystemException" in str(e):
                return None
            raise

    def _renamed(self, held: str, name: str) -> bool:
        fs = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(held), self.path(name), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _leased(self, held: str, name: str) -> bool:
        """The lock is a file that only one writer can create; one older than its lease is moved away by whoever finds it."""
        lock, mine = f"{name}.lock", uuid.uuid4().hex
        try:
            stream = self.fs.create(self.path(lock), False)
            stream.write(bytearray(mine.encode()))
            stream.close()
        except Exception as e:
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            self._expire(lock)
            return False
        try:
            return not self.exists(name) and self.read(lock) == mine and bool(self.fs.rename(self.path(held), self.path(name)))
        finally:
            if self.exists(lock) and self.read(lock) == mine:
                self.delete(lock)

    def _expire(self, lock: str) -> None:
        try:
            age = time.time() - self.fs.getFileStatus(self.path(lock)).getModificationTime() / 1000
        except Exception:
            return  # its writer is done
        if age > LEASE_S:
            gone = f"_{uuid.uuid4().hex}"
            self.fs.rename(self.path(lock), self.path(gone))
            self.delete(gone)

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.path(name), True))
