"""Counts of characters by class as Python's str methods see them, beyond ASCII too: regular expressions' own classes differ in superscripts, circled letters and newer scripts."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each class: which characters it holds, and the ASCII ones among them as a character class.
KINDS = {"digit": (str.isdigit, "[0-9]"), "alpha": (str.isalpha, "[A-Za-z]"), "alnum": (str.isalnum, "[0-9A-Za-z]"), "upper": (str.isupper, "[A-Z]")}


@cache
def beyond_ascii(kind: str) -> str:
    """A character class of all code points beyond ASCII of a kind, as ranges."""
    holds, parts, begin = KINDS[kind][0], [], None
    for k in range(128, sys.maxunicode + 2):
        inside = k <= sys.maxunicode and holds(chr(k))
        if inside and begin is None:
            begin = k
        if not inside and begin is not None:
            parts.append(f"\\x{{{begin:X}}}-\\x{{{k - 1:X}}}")
            begin = None
    return f"[{''.join(parts)}]"


def count_of(s: Column, kind: str) -> Column:
    """How many characters of a text are of a kind. Only what an ASCII text lacks goes through the long class."""
    rest = F.regexp_replace(s, r"[\x00-\x7F]+", "")
    more = F.when(s.rlike(r"[^\x00-\x7F]"), F.regexp_count(rest, F.lit(beyond_ascii(kind)))).otherwise(0)
    return F.regexp_count(s, F.lit(KINDS[kind][1])) + more
