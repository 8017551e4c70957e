"""Small text files beside the data, on file systems that Spark reaches."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = self.path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString()

    def path(self, place: str):
        return self.jvm.org.apache.hadoop.fs.Path(place)

    def names(self, place: str) -> list[str]:
        """What a folder holds; nothing for a folder that doesn't exist."""
        path = self.path(place)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, place: str) -> str:
        stream = self.fs.open(self.path(place))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, place: str, text: str) -> bool:
        """Write a whole file that doesn't exist yet; False if another one was first.

        The text goes to a file of its own name, which then takes its place in one step that
        fails if the place is taken: a hard link on a local disk, a rename without
        overwriting elsewhere. So ``place`` never holds a part of it. The file system must
        rename in one step, as HDFS does and plain object stores don't.
        """
        folder, name = place.rsplit("/", 1)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(own), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if urlparse(self.root).scheme == "file":
                os.link(unquote(urlparse(own).path), unquote(urlparse(place).path))
            else:
                options = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
                none = self.jvm.java.lang.reflect.Array.newInstance(options, 0)
                source, target = self.path(own), self.path(place)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, none)
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        finally:
            self.delete(own)
        return True

    def delete(self, place: str) -> None:
        self.fs.delete(self.path(place), True)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the JVM removes when it ends.

    Where none is named, as in tests on one machine, below the temporary folder; on a
    cluster that is an error, since executors don't see each other's disks.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    place = f"{root.rstrip('/')}/store-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    files = Files(spark, place)
    files.fs.mkdirs(files.path(place))
    files.fs.deleteOnExit(files.path(place))
    return place
