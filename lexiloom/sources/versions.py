"""Numbered states of a table: small JSON files that say which folders belong to it.

A state is written once, under the number after the one it was made from; if another writer was first, the file is there
already and Conflict is raised, with nothing changed. Readers take the greatest number, so they see a whole state or the one before.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

try:
    from py4j.protocol import Py4JJavaError
except ImportError:  # sessions without a JVM gateway don't get here
    Py4JJavaError = PySparkException


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest state; (0, {}) before the first."""
    numbers = [int(m[1]) for n in names(spark, folder) if (m := re.fullmatch(r"(\d+)\.json", n))]
    if not numbers:
        return 0, {}
    fs, p = _at(spark, f"{folder}/{max(numbers):020d}.json")
    stream = fs.open(p)
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, before: int, state: dict) -> int:
    """Write the state that follows number `before`."""
    fs, p = _at(spark, f"{folder}/{before + 1:020d}.json")
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{folder} has changed since state {before}") from None
        raise
    stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    stream.close()
    return before + 1
