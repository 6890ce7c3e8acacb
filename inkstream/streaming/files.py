"""Small files of a stream's own book-keeping, in whatever store its folder is in."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def read_json(spark: SparkSession, path: str) -> dict:
    """A missing file is an error."""
    store, file = _at(spark, path)
    stream = store.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written aside and moved into place, so that a reader sees all of it or none."""
    store, aside = _at(spark, f"{path}.new")
    stream = store.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    _, file = _at(spark, path)
    store.delete(file, False)
    if not store.rename(aside, file):
        raise OSError(f"could not write {path}")


def remove(spark: SparkSession, path: str) -> None:
    store, folder = _at(spark, path)
    store.delete(folder, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    store, folder = _at(spark, path)
    return store.getContentSummary(folder).getLength()


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's entries."""
    store, folder = _at(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
