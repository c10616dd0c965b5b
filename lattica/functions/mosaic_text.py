"""The parts of a mosaic entry as written in its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.let import let
from lattica.functions.paths import base_name

_KEY = r"(?i)^\s*image\s*:\s*"
_BREAK = r"\r\n|\r|\n"
#: Name on the line of the key: up to the first file extension, else the first word.
_NAME = r"^(\S.*?\.[A-Za-z][A-Za-z0-9]{0,4}(?=\s|$)|\S+)"


def entry_lines(entry: Column) -> Column:
    """An entry's first line without its key, its second line, and the rest; one or two where it has no more."""
    return F.transform(F.split(F.ltrim(entry), _BREAK, 3), lambda x, i: F.when(i == 0, F.regexp_replace(x, _KEY, "")).otherwise(x))


def entry_file(entry: Column) -> Column:
    """File name of an entry, without its folder; empty where there is none. Either layout is told by its first line."""
    return let(entry_lines(entry), lambda e: base_name(F.when(e[0] != "", F.regexp_extract(e[0], _NAME, 1)).otherwise(F.coalesce(F.get(e, F.lit(1)), F.lit("")))))


def entry_transform(entry: Column) -> Column:
    """Transform text of an entry; empty where there is none, null for a null entry."""

    def of(e: Column) -> Column:
        rest = F.coalesce(F.get(e, F.lit(2)), F.lit(""))
        one = F.concat_ws("\n", F.regexp_replace(e[0], _NAME, ""), F.coalesce(F.get(e, F.lit(1)), F.lit("")), rest)
        return F.when(e[0] != "", one).otherwise(rest)

    return let(entry_lines(entry), of)
