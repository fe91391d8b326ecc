"""Text helpers as Columns, and path helpers for the driver."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers are read from the start of a text, what follows is ignored.
_INT_PREFIX = r"^\s*([+-]?\d+)"
_FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def int_prefix(c: Column) -> Column:
    """The integer at the start (``10A`` is 10), null if there is none or it is beyond 64 bits."""
    return F.regexp_extract(c, _INT_PREFIX, 1).try_cast("long")


def float_prefix(c: Column) -> Column:
    return F.regexp_extract(c, _FLOAT_PREFIX, 1).try_cast("double")


def missing_to_null(c: Column) -> Column:
    """Null for the missing marks: empty, ``.`` and ``?``."""
    return F.when(~c.isin("", ".", "?"), c)


def split_list(c: Column, separator: str = ",") -> Column:
    """Parts between separators, blanks trimmed, empty ones left out."""
    return F.filter(
        F.transform(F.split(c, "\\" + separator if not separator.isalnum() else separator), lambda x: F.trim(x)), lambda x: x != ""
    )


def number_list(c: Column, separator: str = ",") -> Column:
    """The parts as numbers; null as a whole if one isn't a number."""
    n = F.transform(split_list(c, separator), lambda x: x.try_cast("double"))
    return F.when(~F.exists(n, lambda x: x.isNull()), n)


def strip_carriage_return(c: Column) -> Column:
    return F.regexp_replace(c, r"\r$", "")


def erase(c: Column, character: str) -> Column:
    return F.replace(c, F.lit(character), F.lit(""))


def pad_right(c: Column, width: int) -> Column:
    """Padded with blanks, never cut."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def char_at(c: Column, index: int) -> Column:
    """The character at ``index`` from 0, null beyond the end."""
    return F.when(F.length(c) > index, F.substring(c, index + 1, 1))


def extension(path: Column) -> Column:
    """Lower-case extension with its point, empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def path_extension(path: str) -> str:
    return PurePath(path).suffix.lower()


def with_slash(path: str) -> str:
    return path if path.endswith("/") else path + "/"
