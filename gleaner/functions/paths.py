"""Paths of files and of recording roots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recording_root(path: Column, suffix: str = ".zarr") -> Column:
    """The path up to its first part that ends with ``suffix``; NULL if it has none."""
    found = F.regexp_extract(path, rf"^((?:[^/]+/)*?[^/]*\Q{suffix}\E)(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def extension(path: Column, none: str = "<no extension>") -> Column:
    """The last dotted part of the name, with its dot; names that only start with a dot have none."""
    found = F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(none))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trimmed(path: Column, char: str = "/") -> Column:
    """Without ``char`` at either end."""
    return F.regexp_replace(path, rf"^\Q{char}\E+|\Q{char}\E+$", "")


def relative(path: Column, prefix: str) -> Column:
    """Without ``prefix`` in front, if it is there, and without slashes after it."""
    cut = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if prefix else path
    return F.regexp_replace(cut, "^/+", "")
