"""Source trees, target lists and work folders."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.core import any_of, as_col
from ..functions.urls import with_scheme
from ..operators.extract import language_of


_made: list[tuple[SparkSession, str]] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    All executors must see it, so a session without that setting is refused
    unless it runs in one process.  The folders of a session are removed when
    the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="apiscope-")
    if not _made:
        atexit.register(_remove_made)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove_made() -> None:
    """Remove what `work_path` has named, as far as the session still answers."""
    for spark, path in _made:
        with contextlib.suppress(Exception):  # a stopped session keeps its files
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def is_source_path(path: Column | str,
                   extensions: Sequence[str] = rules.SOURCE_EXTENSIONS) -> Column:
    """Known extension, and not below a dependency or byte-code folder."""
    p = as_col(path)
    wanted = p.rlike(r"\.(?:" + "|".join(extensions) + r")$")
    return wanted & ~p.rlike(any_of(rules.SKIPPED_PATHS))


def source_files(files: DataFrame, *, path: str = "file",
                 extensions: Sequence[str] = rules.SOURCE_EXTENSIONS) -> DataFrame:
    """Files of a (path, text) table that a source scan reads, with language."""
    return files.where(is_source_path(path, extensions)).withColumn("language", language_of(path))


def read_source_tree(spark: SparkSession, root: str, *, max_mb: float | None = None,
                     extensions: Sequence[str] = rules.SOURCE_EXTENSIONS) -> DataFrame:
    """(file, text, language) of a source tree, one row per file.

    Extensions are filtered while listing, skipped folders and the size limit
    by file metadata, before any content is read.  Undecodable bytes are dropped (they become replacement
    characters, and those are removed).
    """
    globs = "*.{" + ",".join(extensions) + "}"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", globs).load(root)
           .where(is_source_path(F.col("_metadata.file_path"), extensions)))
    if max_mb is not None:
        raw = raw.where(F.col("length") <= int(max_mb * 1024 * 1024))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return source_files(raw.select(
        F.regexp_replace("path", "^file:", "").alias("file"), "content"), extensions=extensions).select(
        "file", text.alias("text"), "language")


def targets(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Targets of a one-per-line list: blanks and ``#`` lines dropped.

    The comment test looks at the raw line, so an indented ``#`` survives.
    """
    raw = F.col(line)
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return lines.where((trimmed != "") & ~raw.startswith("#")).select(
        trimmed.alias("target"), with_scheme(trimmed).alias("target_url"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return targets(spark.read.text(path))
