"""Column functions for missing values, blanks and substring search as the data model means them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def py_strip(c: Column) -> Column:
    """Without blanks of any kind at the ends, also ideographic ones."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    """Null or the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def filled(c: Column, default: str) -> Column:
    return F.when(blank(c), F.lit(default)).otherwise(c)


def has_answer(c: Column) -> Column:
    return py_strip(F.coalesce(c, F.lit(""))) != ""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like_ci(c: Column, q: str) -> Column:
    """Whether ``q`` occurs in ``c``, ASCII letters of either case alike; ``%`` and ``_`` in ``q`` are wild, nothing escapes them."""
    folded = q.translate(str.maketrans(UPPER, LOWER))
    if "%" not in q and "_" not in q:
        return F.contains(ascii_lower(c), F.lit(folded))
    escape = next(x for x in "\x01\x02\x03" if x not in q)
    literal = folded.replace("'", "''").replace("\\", "\\\\")
    return F.like(ascii_lower(c), F.lit(f"%{folded}%"), F.lit(escape)) if literal else F.lit(True)


def any_like(q: str, *columns: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(like_ci(F.col(c), q), F.lit(False))
    return found


def json_strings(c: Column) -> Column:
    """The strings of a JSON array; an empty array for anything else."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
