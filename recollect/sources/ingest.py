"""Documents of folders: whole text files with their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of the files that are read.
EXTENSIONS = ("md", "txt", "py", "rs", "cpp", "hpp", "c", "h", "yaml", "yml", "json", "toml", "sh", "r", "R")


def source_type(source: str) -> str:
    """url, directory or file."""
    if source.startswith(("http://", "https://")):
        return "url"
    return "directory" if source.endswith("/") else "file"


def read_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, content of every file below a folder that has one of the endings and isn't empty; the content names its source first.

    A file is one row; files are dealt over tasks by Spark. Other files aren't opened.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.where("value <> ''").select(path.alias("path"), F.concat(F.lit("# Source: "), path, F.lit("\n\n"), F.col("value")).alias("content"))
