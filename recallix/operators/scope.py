"""Predicates on owners, projects, validity and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL = "system_global"


def of_user(user: str | None, column: str = "user_id") -> Column:
    return F.lit(True) if user is None else F.col(column) == user


def of_project(project: str | None, column: str = "project_id") -> Column:
    """The project's own rows, global ones and those without a project."""
    p = F.col(column)
    return F.lit(True) if project is None else (p == project) | (p == GLOBAL) | p.isNull()


def salient(least: float | None, column: str = "salience") -> Column:
    return F.col(column) >= least if least else F.lit(True)


def created_between(low: int | None, high: int | None, column: str = "created_at") -> Column:
    c = F.col(column)
    return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)


def valid_at(at: int) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))


def valid_in(low: int | None, high: int | None) -> Column:
    """Overlaps the range or starts in it; with one end given, the start alone decides."""
    f, t = F.col("valid_from"), F.col("valid_to")
    if low is not None and high is not None:
        return ((f <= high) & (t.isNull() | (t >= low))) | f.between(low, high)
    return f >= low if low is not None else f <= high if high is not None else F.lit(True)


def meta_equals(column: str, path: str, value: str) -> Column:
    return F.get_json_object(F.col(column), path) == value


def like(column: str, part: str) -> Column:
    """Contains the part, whatever its case; % and _ in it are wildcards."""
    return F.col(column).ilike(f"%{part}%")
