"""A small value that is replaced in one step: a new numbered file, of which the highest number counts.

A file is written under a temporary name and renamed to a number that is not taken yet; nothing is deleted before that, so
a failure at any moment leaves either the value before or the new one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

NAME = re.compile(r"^CURRENT-(\d{12})$")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(m[1]) for m in map(NAME.match, names) if m)


def get(spark: SparkSession, path: str) -> str | None:
    """The value under a folder, or None."""
    folder, fs = _folder(spark, path)
    numbers = _numbers(fs, folder)
    return spark.read.text(f"{path}/CURRENT-{numbers[-1]:012d}").first()[0] if numbers else None


def put(spark: SparkSession, path: str, value: str) -> None:
    """Replace the value. Of two writers at once one fails."""
    folder, fs = _folder(spark, path)
    numbers = _numbers(fs, folder)
    fs.mkdirs(folder)
    make = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    temp = make(f".{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(value.encode()))
    out.close()
    if not fs.rename(temp, make(f"CURRENT-{(numbers[-1] if numbers else 0) + 1:012d}")):
        raise OSError(f"{path}: another writer was faster")
    for old in numbers[:-1]:  # the one before stays for readers that have just listed it
        fs.delete(make(f"CURRENT-{old:012d}"), False)
