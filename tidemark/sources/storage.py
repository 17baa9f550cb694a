"""Files that must be created once: exclusive creation in a folder that all processes share, and scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in ``spark.checkpoint.dir``; only a local session may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _located(spark, path)
    return fs.exists(where)


def create_once(spark: SparkSession, path: str, data: bytes) -> bool:
    """Whether this call created the file; False if it was there.  The file system decides, so of any number of callers one wins."""
    where, fs = _located(spark, path)
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        return True
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    out.write(bytearray(data))
    out.close()
    return True


def read_whole(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    where, fs = _located(spark, path)
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()
