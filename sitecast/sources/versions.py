"""Versioned folders with a pointer to the current one.

A version is written to a folder of its own and becomes current by replacing the pointer file,
a rename over the old one, so a writer that dies half-way leaves the last version in force.
The newest versions are kept, older ones removed after the pointer has moved; other files in the
folder are left alone. The rename is
atomic on file systems that rename atomically (HDFS, local and shared disks); one writer at a
time is assumed.
"""

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

POINTER = "_current.json"
PREFIX = "v-"
KEEP = 3


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder and all in it; a path that does not exist is fine."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place of the last one, so that readers see the old or the new."""
    jvm = spark._jvm
    fs, target = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)


def manifest(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """What the pointer says: the versions in force, oldest first, and notes; None without any."""
    path = f"{root}/{POINTER}"
    return json.loads(read_text(spark, path)) if exists(spark, path) else None


def commit(
    spark: SparkSession, root: str, write: Callable[[str], dict | None], keep: int = KEEP
) -> str:
    """Writes a version by `write(folder)` and makes it current; returns its folder.

    What `write` returns goes into the pointer file as notes, in the same step. If it fails, the
    last version stays current. What an earlier failure left behind is removed together with the
    versions beyond `keep`.
    """
    if keep < 1:
        raise ValueError("keep at least the current version")
    held = manifest(spark, root) or {"versions": []}
    name = f"{PREFIX}{uuid.uuid4().hex}"
    notes = write(f"{root}/{name}")
    versions = [*held["versions"], name][-keep:]
    replace_text(spark, f"{root}/{POINTER}", json.dumps({"versions": versions, "notes": notes}))
    fs, folder = _fs(spark, root)
    for status in fs.listStatus(folder):
        found = status.getPath().getName()
        if found.startswith((PREFIX, f"{POINTER}.")) and found not in versions:
            fs.delete(status.getPath(), True)
    return f"{root}/{name}"


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version."""
    held = manifest(spark, root)
    return f"{root}/{held['versions'][-1]}" if held else None


def earlier(spark: SparkSession, root: str) -> list[str]:
    """Folders of all kept versions, oldest first."""
    held = manifest(spark, root)
    return [f"{root}/{v}" for v in held["versions"]] if held else []
