"""Column names that a frame does not have yet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as set it apart from the names taken."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of this name, whatever signs the name has."""
    return F.col(f"`{name.replace('`', '``')}`")
