"""Clean-up of category labels, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular-expression class body that Java and RE2 both read.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}"


def clean_label(col: Column) -> Column:
    """Strip, lower-case, runs of white space, ``-`` and ``_`` to one ``_``; null, empty and ``nan`` are null."""
    stripped = F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")
    joined = F.regexp_replace(F.lower(stripped), f"[{SPACE}_-]+", "_")
    return F.when(~joined.isin("", "nan"), joined)


def clean_label_sql(col: str) -> str:
    """:func:`clean_label` as DuckDB SQL."""
    stripped = f"regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    joined = f"regexp_replace(lower({stripped}), '[{SPACE}_-]+', '_', 'g')"
    return f"nullif(nullif({joined}, ''), 'nan')"


def clean_source(col: Column) -> Column:
    """Strip and lower-case; null and empty are null."""
    stripped = F.lower(F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.when(stripped != "", stripped)


def clean_source_sql(col: str) -> str:
    return f"nullif(lower(regexp_replace({col}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '')"
