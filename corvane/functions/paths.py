"""Path predicates and parts, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are indexed, and directory names that are not entered.
SUPPORTED = [".md", ".markdown", ".txt", ".c", ".h", ".cpp", ".py", ".js", ".ts", ".m"]
IGNORED = ["node_modules", "images", "assets", "_assets", "dist", "build", "slprj", "model"]


def normalised(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, in lower case; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def is_ignored(path: Column) -> Column:
    return F.exists(F.split(path, r"[\\/]+"), lambda part: part.startswith(".") | F.lower(part).isin(IGNORED))


def is_supported(path: Column) -> Column:
    return ~is_ignored(path) & extension(normalised(path)).isin(SUPPORTED)


def file_type(path: Column) -> Column:
    return F.when(extension(path).isin(".md", ".markdown"), "markdown").otherwise("code")


def is_safe(path: Column) -> Column:
    """Relative, without NUL, colon or escape from the root; links are checked where files are opened."""
    slashed = normalised(path)
    step = F.aggregate(
        F.filter(F.split(slashed, "/+"), lambda p: ~p.isin("", ".")),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), (s["out"] | ((p == "..") & (s["depth"] == 0))).alias("out")
        ),
        lambda s: s["out"],
    )
    return F.coalesce((F.length(path) > 0) & ~path.contains("\0") & ~path.contains(":") & ~slashed.startswith("/") & ~step, F.lit(False))
