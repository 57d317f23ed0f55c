"""Numbered commits: what is in a folder is what the records in it say, one after the other.

A record is made whole under another name and then given its number, which works only if no one has it yet; so a commit
is there or isn't, of two writers one gets the number and the other a Conflict, and nothing is locked. What a writer
that failed has left is named by no record.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

#: Digits of a number in a file's name.
_DIGITS = 20
#: File systems whose rename fails where the new name is taken.
_RENAMING = ("hdfs", "viewfs", "abfs", "abfss")


class Conflict(Exception):
    """Someone else has written since."""


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folder's records, ascending."""
    p, store = _hadoop(spark, folder)
    if not store.exists(p):
        return []
    return sorted(int(name[:_DIGITS]) for f in store.listStatus(p) if (name := f.getPath().getName()).endswith(".json") and name[:_DIGITS].isdigit())


def last(spark: SparkSession, folder: str) -> int:
    """The last record's number; 0 if there is none."""
    return max(numbers(spark, folder), default=0)


def file_of(folder: str, n: int) -> str:
    return f"{folder}/{n:0{_DIGITS}d}.json"


def record(spark: SparkSession, folder: str, n: int) -> dict:
    p, store = _hadoop(spark, file_of(folder, n))
    f = store.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(f)))
    finally:
        f.close()


def create(spark: SparkSession, folder: str, n: int, what: dict) -> None:
    """Make record n, or raise Conflict where there is one."""
    p, store = _hadoop(spark, folder)
    store.mkdirs(p)
    raw, scheme = json.dumps(what, separators=(",", ":")).encode() + b"\n", store.getUri().getScheme()
    if scheme == "file":
        local = unquote(urlparse(folder).path)
        made = f"{local}/.{uuid.uuid4().hex}"
        with open(made, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(made, file_of(local, n))
        except FileExistsError:
            raise Conflict(f"{folder} has a record {n}") from None
        finally:
            os.remove(made)
        return
    if scheme not in _RENAMING:
        raise ValueError(f"{scheme}: commits need a file system that refuses to rename onto a name that is taken ({', '.join(_RENAMING)} or local)")
    made, target = (_hadoop(spark, f)[0] for f in (f"{folder}/.{uuid.uuid4().hex}", file_of(folder, n)))
    out = store.create(made, False)
    out.write(raw)
    out.hsync()
    out.close()
    if store.exists(target) or not store.rename(made, target):
        store.delete(made, False)
        raise Conflict(f"{folder} has a record {n}")
