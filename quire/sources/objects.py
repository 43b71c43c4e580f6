"""Small objects on shared storage, through the file systems that Spark itself uses."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Creates an empty object; False if there is one already, whoever made it.

    Of several writers exactly one succeeds, as far as the store can tell: HDFS and stores
    with conditional writes decide it themselves; on a local disk the exclusive creation of
    the operating system does, which Hadoop's local file system does not use.
    """
    store, place = _place(spark, path)
    store.mkdirs(place.getParent())
    try:
        if store.getScheme() == "file":
            _create_local(spark, store.makeQualified(place).toUri().getPath())
        else:
            store.create(place, False).close()
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


def _create_local(spark: SparkSession, path: str) -> None:
    files, array = spark._jvm.java.nio.file, spark.sparkContext._gateway.new_array
    place = files.Paths.get(path, array(spark._jvm.String, 0))
    files.Files.createFile(place, array(files.attribute.FileAttribute, 0))


def write_object(spark: SparkSession, path: str, text: str) -> None:
    """A small text, whole or not there: readers must not take part of one for all of it."""
    store, place = _place(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_object(spark: SparkSession, path: str) -> str | None:
    """The text of a small object; None if it is gone."""
    store, place = _place(spark, path)
    try:
        source = store.open(place)
    except Py4JJavaError as problem:
        if "FileNotFound" in problem.java_exception.getClass().getName():
            return None
        raise
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder. For folders that hold
    a bounded number of objects."""
    store, place = _place(spark, folder)
    try:
        return sorted(entry.getPath().getName() for entry in store.listStatus(place))
    except Py4JJavaError as problem:
        if "FileNotFound" in problem.java_exception.getClass().getName():
            return []
        raise
