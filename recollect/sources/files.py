"""The files that a table consists of, from their listing alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = "^([a-z0-9+.-]+):/+"


def place(path: Column) -> Column:
    """A path in the one form that listings and file columns share."""
    return F.regexp_replace(path, _SCHEME, "$1:/")


def listing(table: DataFrame) -> dict[str, tuple[str, int]]:
    """Path: (state, bytes) of every file; no row is read. The driver holds a row for each file, as Spark's own planning does."""
    spark = table.sparkSession
    conf, found = spark._jsc.hadoopConfiguration(), {}
    for path in table.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(conf).getFileStatus(at)
        found[re.sub(_SCHEME, r"\1:/", path)] = (f"{status.getModificationTime()}-{status.getLen()}", status.getLen())
    return found


def remove(table: DataFrame, path: str) -> None:
    """Delete what was written to a path, through the file system that it is on."""
    at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
