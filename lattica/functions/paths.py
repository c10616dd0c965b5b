"""Path spelling as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.let import let

#: White space of Unicode and the byte order mark, fixed values.
_SPACES = " \t\n\v\f\r\u0085                 　﻿"
_DRIVE = r"^[A-Za-z]:/"


def trimmed(path: Column) -> Column:
    """Without surrounding white space; empty where nothing else is there."""
    return F.trim(path, F.lit(_SPACES))


def unslashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_blank(path: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(trimmed(path), F.lit("")) == ""


def _push(acc: Column, seg: Column) -> Column:
    up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.when((seg == "") | (seg == "."), acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))


def _folded(p: Column) -> Column:
    segments = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), _push)
    return F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(segments, "/"))


def resolved_path(path: Column, base: Column | None = None) -> Column:
    """Absolute form of ``path``: slash style, repeated slashes, ``.``, ``..``, relative paths and surrounding white space.

    Null gives null, blank the root of ``base``: ask ``is_blank`` first. A relative path starts at ``base``; where that is
    null it stays relative. ``..`` above the root is dropped. The segment fold runs only for paths that need it.
    """

    def settled(p: Column) -> Column:
        dirty = p.contains("//") | p.contains("/.") | p.endswith("/") | p.startswith("./") | p.startswith("../")
        return F.when(dirty, _folded(p)).otherwise(p)

    own = unslashed(trimmed(path))
    if base is None:
        return let(own, settled)
    rooted = lambda p: F.when(p.startswith("/") | p.rlike(_DRIVE) | base.isNull(), p).otherwise(F.concat(unslashed(trimmed(base)), F.lit("/"), p))
    return let(let(own, rooted), settled)


def base_name(path: Column) -> Column:
    """Last part of a path, whatever its slashes and surrounding white space."""
    return trimmed(F.substring_index(F.rtrim(unslashed(trimmed(path)), F.lit("/")), "/", -1))
