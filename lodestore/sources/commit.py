"""Files that come to be once: of writers that race for a name exactly one gets it, and its content is whole from the start."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, system, system.makeQualified(where)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with the text; False, and nothing done, if the name is taken.

    The text goes to a name of its own first. Local files are then linked, others renamed without overwriting: either
    fails as one step where the name exists. The file system must rename so (HDFS does); a store that can't is refused.
    """
    jvm, system, where = _place(spark, path)
    system.mkdirs(where.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if where.toUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), where.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            system.delete(draft, False)
    try:
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(draft, where, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        with contextlib.suppress(Exception):
            system.delete(draft, False)
        if system.exists(where):
            return False
        raise


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, without drafts, in order; nothing if it isn't there."""
    _, system, where = _place(spark, path)
    return sorted(n for n in (f.getPath().getName() for f in system.listStatus(where)) if not n.startswith(".")) if system.exists(where) else []


def text_of(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    jvm, system, where = _place(spark, path)
    if not system.exists(where):
        return None
    held = system.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def remove(spark: SparkSession, path: str) -> None:
    _, system, where = _place(spark, path)
    system.delete(where, True)
