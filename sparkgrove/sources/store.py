"""Tables that are replaced as a whole: each version in a folder of its own, and a pointer that names the current one.

A version is complete before the pointer changes, and the pointer changes by one rename, so a reader sees the old
version or the new one, never a part. What a failed write leaves behind is in a folder that no pointer names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and how to make a path of it."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the newest pointer; pointers are numbered, as not every file system can replace a file by renaming."""
    files, at = _hadoop(spark, path)
    if not files.exists(at(path)):
        return None
    names = [s.getPath().getName() for s in files.listStatus(at(path)) if s.getPath().getName().startswith(_POINTER)]
    return max(names, default=None)


def save(df: DataFrame, path: str) -> str:
    """Writes ``df`` as the new version of the table at ``path`` and returns the version's name.

    ``df`` may read the version before it, which stays until ``clean``. Of two writers at a time one fails.
    """
    spark = df.sparkSession
    last = _current(spark, path)
    number = int(last.split("-")[1]) + 1 if last else 1
    version = f"{number:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    files, at = _hadoop(spark, path)
    draft = at(f"{path}/.draft-{version}")
    files.create(draft, True).close()
    pointer = at(f"{path}/{_POINTER}-{version}")
    if _current(spark, path) != last or not files.rename(draft, pointer):
        raise RuntimeError(f"{path} was written by somebody else meanwhile")
    return version


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``; FileNotFoundError if there is none."""
    last = _current(spark, path)
    if last is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{last[len(_POINTER) + 1 :]}")


def clean(spark: SparkSession, path: str) -> int:
    """Deletes all but the current version, and says how many; for when nobody reads or writes the others."""
    files, at = _hadoop(spark, path)
    last = _current(spark, path)
    keep = {last, last[len(_POINTER) + 1 :]} if last else set()
    old = [s.getPath() for s in files.listStatus(at(path)) if s.getPath().getName() not in keep] if files.exists(at(path)) else []
    for place in old:
        files.delete(place, True)
    return sum(not p.getName().startswith((_POINTER, ".draft")) for p in old)


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes a table; False if there is none."""
    files, at = _hadoop(spark, path)
    return bool(files.exists(at(path)) and files.delete(at(path), True))
