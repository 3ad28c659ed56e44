"""Names, moves and deletions in folders, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none where there is no folder."""
    fs, own = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(own)] if fs.exists(own) else []


def delete(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all that is in it, goes."""
    fs, own = _at(spark, path)
    fs.delete(own, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A file or folder gets another place."""
    fs, own = _at(spark, path)
    if not fs.rename(own, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be moved to {to}")


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files that a path or pattern names, or that are below the folders it names, ascending; those whose names begin with a
    dot or an underscore are left out."""
    fs, own = _at(spark, path)
    found = []
    for top in fs.globStatus(own) or []:
        every = fs.listFiles(top.getPath(), True)
        while every.hasNext():
            at = every.next().getPath()
            if not at.getName().startswith((".", "_")):
                found.append(at.toString())
    if not found and not fs.globStatus(own):
        raise FileNotFoundError(path)
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, None for an empty one."""
    fs, own = _at(spark, path)
    jvm = spark._jvm.java.io
    lines = jvm.BufferedReader(jvm.InputStreamReader(fs.open(own), "UTF-8"))
    try:
        return lines.readLine()
    finally:
        lines.close()
