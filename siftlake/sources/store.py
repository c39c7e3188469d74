"""The few file operations that a commit log needs, by the file system of the path."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str) -> tuple:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename one file, making the folder of the new name."""
    jvm, fs, where = _file_system(spark, target)
    fs.mkdirs(where.getParent())
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(source), where):
        raise OSError(f"cannot rename {source} to {target}")


def entry_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name the JSON entries of a log folder; none where there is no folder."""
    _, fs, where = _file_system(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole under a name that is not taken; False, with nothing changed, where it is.

    The text goes to a hidden file first, which then gets the name: by a rename that does not overwrite, or by a hard
    link on a local file system, where a rename would overwrite. Either is one atomic step of the file system.
    """
    jvm, fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    hidden = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            to_local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(to_local(where), to_local(hidden))
        else:
            no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri()).rename(hidden, where, no_overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(hidden, False)
    return True
