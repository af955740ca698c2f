"""Paths with backslashes, in which archives count as folders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normcase(path: Column) -> Column:
    return F.lower(F.translate(path, "/", "\\"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def dir_name(path: Column) -> Column:
    """All before the last separator; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)


def suffix(name: Column) -> Column:
    """The extension in lower case with its dot; empty for none, for a leading or a trailing dot alone."""
    base = base_name(name)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.lower(F.regexp_extract(base, r"(\.[^.]+)$", 1))).otherwise("")


def dir_prefix(folder: Column) -> Column:
    """The folder with one separator behind it."""
    return F.concat(F.regexp_replace(folder, r"[\\/]+$", ""), F.lit("\\"))


def is_inside(path: Column, folder: Column) -> Column:
    """Whether the path lies in the folder, at any depth, in whatever case: neighbours that begin alike don't."""
    return F.startswith(normcase(path), normcase(dir_prefix(folder)))


def inside_range(path_lc: Column, folder_lc: str) -> Column:
    """The same as a range over a lower-case path column, which Parquet can skip by."""
    stem = folder_lc.rstrip("\\/")
    return (path_lc >= stem + "\\") & (path_lc < stem + "]")


def relative(path: Column, folder: Column) -> Column:
    return F.when(is_inside(path, folder), F.substr(path, F.length(dir_prefix(folder)) + 1)).otherwise(path)


def below(path: Column, folder: Column) -> Column:
    """The parts of a path below a folder."""
    return F.filter(F.split(relative(path, folder), r"[\\/]"), lambda x: x != "")


def search_name(path: Column, folder: Column) -> Column:
    """What a file is found by: its name, then the folders below the root, outermost first."""
    parts = below(path, folder)
    return F.array_join(F.concat(F.slice(parts, -1, 1), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))), " ")


def embed_title(path: Column, folder: Column) -> Column:
    """The last two parts below the root."""
    parts = below(path, folder)
    n = F.least(F.size(parts), F.lit(2))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/")


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, r"\\")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
