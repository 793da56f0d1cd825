"""Reading a folder of text files ("vault"): scan, safe paths, line ranges."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths

MAX_PATH = 4096


def scan(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, content, mtime (ms), file_type of all supported files below ``root``, read by Spark's file source.

    Works on any file system Spark can list. Where links must not be followed, use local_paths.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = paths.normalised(F.substring(path, F.length(base) + 2, F.length(path)))
    found = files.select(relative.alias("relative_path"), "content", F.unix_millis("modificationTime").alias("mtime"))
    kept = found.where(paths.is_supported(F.col("relative_path")))
    return kept.select("relative_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "mtime", paths.file_type(F.col("relative_path")).alias("file_type"))


def local_paths(root: str) -> list[str]:
    """Relative paths of regular files below a local folder; links, hidden and ignored names are not entered.

    Any listing error is raised before a path is returned, so an incomplete scan never looks
    like a vault from which files have gone.
    """

    def fail(error: OSError) -> None:
        raise error

    found = []
    for folder, folders, names in os.walk(root, followlinks=False, onerror=fail):
        folders[:] = [f for f in folders if not f.startswith(".") and f.lower() not in paths.IGNORED and not os.path.islink(os.path.join(folder, f))]
        for name in names:
            full = os.path.join(folder, name)
            ignored = name.startswith(".") or name.lower() in paths.IGNORED
            if not ignored and os.path.splitext(name)[1].lower() in paths.SUPPORTED and os.path.isfile(full) and not os.path.islink(full):
                found.append(os.path.relpath(full, root).replace(os.sep, "/"))
    return sorted(found)


def read_one(root: str, relative: str) -> tuple[str | None, int | None, str | None]:
    """(content, mtime in ms, error) of one file.

    A file that is gone, not a regular file or behind a link has neither content nor error; any
    other failure is that file's error.
    """
    full = os.path.join(root, *relative.split("/"))
    try:
        found = os.lstat(full)
        if not stat.S_ISREG(found.st_mode) or has_link(root, relative):
            return None, None, None
        with open(full, "rb") as file:
            return file.read().decode("utf-8", "replace"), int(found.st_mtime * 1000), None
    except (FileNotFoundError, NotADirectoryError):
        return None, None, None
    except OSError as error:
        return None, None, str(error) or type(error).__name__


def read_files(names: DataFrame, root: str) -> DataFrame:
    """names(relative_path) with content, mtime, file_type and error (see read_one); ``root`` is a folder that all executors see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time is in memory
                content, mtime, error = read_one(root, batch.column(0)[at].as_py())
                columns = [batch.column(0).slice(at, 1), pa.array([content], pa.string()), pa.array([mtime], pa.int64()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["relative_path", "content", "mtime", "error"])

    found = names.select("relative_path").mapInArrow(run, "relative_path string, content string, mtime bigint, error string")
    return found.withColumn("file_type", paths.file_type(F.col("relative_path")))


def has_link(root: str, relative: str) -> bool:
    """Is any component below the root a symbolic link?"""
    at = os.path.realpath(root)
    for part in [p for p in relative.replace("\\", "/").split("/") if p not in ("", ".")]:
        at = os.path.join(at, part)
        if os.path.islink(at):
            return True
    return False


def resolve(root: str, relative: str) -> str:
    """The absolute path of a file in the vault; ValueError if the path leaves it, by name or by link."""
    if not relative or len(relative) > MAX_PATH or "\0" in relative or ":" in relative or relative[0] in "/\\":
        raise ValueError("a relative path inside the vault is needed")
    base = os.path.realpath(root)
    plain = os.path.normpath(os.path.join(base, *relative.replace("\\", "/").split("/")))
    for candidate in (plain, os.path.realpath(plain)):
        if os.path.commonpath([base, candidate]) != base:
            raise ValueError("the path leaves the vault")
    if not os.path.exists(plain):
        raise FileNotFoundError(relative)
    return os.path.realpath(plain)


def checked_range(start: int | None, end: int | None) -> None:
    for n in (start, end):
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
            raise ValueError("line numbers are positive whole numbers")
    if start is not None and end is not None and end < start:
        raise ValueError("the range ends before it starts")


def line_range(content: Column, start: int | None = None, end: int | None = None) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive) joined by newlines; beyond the end there are none."""
    checked_range(start, end)
    first, last = (start or 1) - 1, end
    lines = F.filter(F.split(content, "\r?\n"), lambda _, i: (i >= first) & (F.lit(True) if last is None else i < last))
    return F.array_join(lines, "\n")


def read_lines(root: str, relative: str, start: int | None = None, end: int | None = None) -> str:
    """The same range of one local file."""
    checked_range(start, end)
    path = resolve(root, relative)
    if not os.path.isfile(path):
        raise ValueError("not a regular file")
    with open(path, encoding="utf-8", errors="replace", newline="") as file:
        lines = file.read().replace("\r\n", "\n").split("\n")
    return "\n".join(lines[(start or 1) - 1 : end])
