"""Tokens: matches of the public wordpunct pattern ``\\w+|[^\\w\\s]+`` with Unicode classes.

The classes are written out so that Java, RE2 and Python find the same matches: a word character is a letter, a number
or ``_``, white space is what Unicode and Python take for it. Only characters newer than the Unicode version of the
Java at hand can differ: Java takes them for neither, so they count as punctuation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantell.functions.labels import SPACE

WORD = r"\p{L}\p{N}_"
TOKEN = f"[{WORD}]+|[^{WORD}{SPACE}]+"
#: The same in Python, for what must be done there.
PYTHON_TOKEN = re.compile(r"\w+|[^\w\s]+")


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def token_count_sql(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{TOKEN}')), 0)"
