"""Commit marks: what a stream's sink has made visible.

A batch writes its files first and then one small mark, which appears at once or not at all. Readers start from the last mark and see only
what it names, so files of a batch that failed are never read, and a batch that runs again finds its mark or writes its files anew.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from scriptorium.sources.scratch import file_system

FOLDER = "_commits"  # Spark's readers pass over names that begin with an underscore


def last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of the last mark below path; -1 and nothing if there is none."""
    fs, at = file_system(spark, f"{path}/{FOLDER}")
    if not fs.exists(at):
        return -1, {}
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    if not found:
        return -1, {}
    last = max(found, key=lambda p: int(p.getName()))
    stream = fs.open(last)
    try:
        content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(last.getName()), json.loads(content)


def commit(spark: SparkSession, path: str, n: int, content: dict) -> None:
    """Marks batch n, by renaming a file that is complete; marks before the last two go."""
    fs, new = file_system(spark, f"{path}/{FOLDER}/.{n}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    _, mark = file_system(spark, f"{path}/{FOLDER}/{n}")
    if not fs.rename(new, mark):
        raise OSError(f"could not mark batch {n} in {path}")
    for status in fs.listStatus(mark.getParent()):
        name = status.getPath().getName()
        if name.isdigit() and int(name) < n - 1:
            fs.delete(status.getPath(), False)
