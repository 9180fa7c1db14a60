"""Files of any Hadoop file system: existence, deletion, and writing in one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def open_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = open_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = open_path(spark, path)
    fs.delete(p, True)


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Write a file beside ``path`` and rename it over that: readers see the old content or the new, never none or a part."""
    context, folder = spark.sparkContext, path.rsplit("/", 1)[0]
    fs, temp = open_path(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(content.encode()))
    out.close()
    hadoop = context._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    how = context._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(open_path(spark, path)[1]), how)
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def read_file(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
