"""Small files that only one writer can create: claimed numbers, and commits that follow one another.

A claim is taken by creating its file, which fails if the file is there. On a local file system the
content is linked into place, so that the file appears whole; other systems create without
overwriting, which HDFS and stores with conditional writes do atomically.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_if_absent(spark: SparkSession, path: str, content: str = "") -> bool:
    """Create the file with this content; False if another one was there first."""
    system, place = _place(spark, path)
    if system.getUri().getScheme() == "file":
        target = place.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        stream = system.create(place, False)
    except Py4JJavaError:
        if system.exists(place):
            return False
        raise
    stream.write(bytearray(content.encode("utf-8")))
    stream.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of the files in a folder; none if there is no folder. Drafts are left out."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(name for name in names if not name.startswith("."))


def claim_next(spark: SparkSession, folder: str, after: int) -> int:
    """The first number above ``after`` that nobody has claimed in the folder; it is claimed now."""
    number = after + 1
    while not create_if_absent(spark, f"{folder}/{number:012d}"):
        number += 1
    return number
