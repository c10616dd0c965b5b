"""Quantities written in different units and notations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanometres in a length unit by its spellings, fixed values.
UNIT_NM = {
    "nm": 1.0, "nanometer": 1.0, "nanometers": 1.0, "nanometre": 1.0, "nanometres": 1.0, "nanometern": 1.0, "nanomètre": 1.0, "nanomètres": 1.0,
    "µm": 1e3, "μm": 1e3, "um": 1e3, "micron": 1e3, "microns": 1e3, "micrometer": 1e3, "micrometers": 1e3, "micrometre": 1e3, "micrometres": 1e3, "mikrometer": 1e3, "mikrometern": 1e3, "mikron": 1e3,
    "mm": 1e6, "millimeter": 1e6, "millimeters": 1e6, "millimetre": 1e6, "millimetres": 1e6, "millimetern": 1e6,
    "cm": 1e7, "centimeter": 1e7, "centimeters": 1e7, "centimetre": 1e7, "centimetres": 1e7,
    "m": 1e9, "meter": 1e9, "meters": 1e9, "metre": 1e9, "metres": 1e9,
    "å": 0.1, "angstrom": 0.1, "angstroms": 0.1, "ångström": 0.1,
}
#: Spellings of pixels, fixed values.
PIXELS = ("px", "pix", "pixel", "pixels", "pxl")
_WORDS = sorted([*UNIT_NM, *PIXELS], key=len, reverse=True)
#: A unit word not inside another word.
_UNIT = rf"(?<![\p{{L}}_])({'|'.join(_WORDS)})(?![\p{{L}}_])"
_FULL = r"(?i)full(?:[\s_-]*)(?:res\b|resolution)|native\s+res|level\s*0\b"
#: Where a remark speaks of the coordinates, then names their unit.
_COORDINATES = rf"(?iu)(?:coordinates?|coords?|points?|units?|koordinaten|punkte|einheit(?:en)?|coordonnées|unités?)\b[^,;.]{{0,40}}?{_UNIT}"
_NUMBER = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"


def unit_scale(word: Column) -> Column:
    """Nanometres in the unit ``word``, 0 for pixels, null where it is none."""
    w = F.lower(F.trim(word))
    table = F.create_map(*[F.lit(x) for k, v in [*UNIT_NM.items(), *((p, 0.0) for p in PIXELS)] for x in (k, v)])
    return F.try_element_at(table, w)


def unit_in(text: Column) -> Column:
    """Scale (``unit_scale``) of the first unit that ``text`` names; null where it names none."""
    # Numbers may touch their unit (12nm, 3 µm).
    return unit_scale(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "(?iu)" + _UNIT, 1), F.lit("")))


def remark_unit(remark: Column) -> Column:
    """Scale of the unit that a remark gives for coordinates, points or units; other quantities it mentions don't count."""
    return unit_scale(F.nullif(F.regexp_extract(F.coalesce(remark, F.lit("")), _COORDINATES, 1), F.lit("")))


def says_full_resolution(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_FULL)


def numbers_in(text: Column) -> Column:
    """All decimal numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"({_NUMBER})"), 1), lambda x: F.regexp_replace(x, ",", ".").try_cast("double"))


def power_of_two(value: Column) -> Column:
    """``value`` as a whole power of two from 1 to 2^30; null where it is none."""
    n = F.round(F.log2(value))
    return F.when((value > 0) & n.between(0, 30) & (F.abs(value / F.pow(F.lit(2.0), n) - 1) < 1e-6), F.pow(F.lit(2.0), n).cast("bigint"))


def downsample_factor(text: Column) -> Column:
    """The power of two that a downsample means in any of its notations; null where it is unreadable."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    n = r"(\d+(?:[.,]\d+)?)"
    get = lambda pattern, i=1: F.regexp_replace(F.regexp_extract(t, pattern, i), ",", ".").try_cast("double")
    ratio, level, power, percent, plain = rf"^{n} ?[:/] ?{n}$", r"^(?:pyramid ?)?(?:level|lvl|lev|l) ?[:=#]? ?(\d+)$", r"^2 ?(?:\^|\*\*) ?(\d+)$", rf"^{n} ?%$", rf"^(?:ds ?=? ?|x ?|× ?|downsample ?[:=]? ?|1 ?in ?)?{n} ?(?:x|×|-?fold)?$"
    a, b = get(ratio, 1), get(ratio, 2)
    fraction = get(plain)
    value = (
        F.when(t.rlike(level), F.pow(F.lit(2.0), get(level)))
        .when(t.rlike(power), F.pow(F.lit(2.0), get(power)))
        .when(t.rlike(percent), F.when(get(percent) > 0, F.try_divide(F.lit(100.0), get(percent))))
        .when(t.rlike(ratio), F.when((a == 1) & (b > 0), b).when((b == 1) & (a > 0), a))
        .when(t.rlike(plain), F.when((fraction > 0) & (fraction < 1), F.try_divide(F.lit(1.0), fraction)).otherwise(fraction))
    )
    return power_of_two(F.when(value < 1, F.try_divide(F.lit(1.0), value)).otherwise(value))


def written_number(text: Column) -> Column:
    """The number that a text holds, whatever it means; a ratio or power of two numbers is worked out. Null where it holds none."""
    t = F.coalesce(text, F.lit(""))
    n, get = numbers_in(t), lambda k: F.get(numbers_in(t), F.lit(k))
    two = rf"{_NUMBER}\s*%s\s*{_NUMBER}"
    return F.when(t.rlike(two % "[:/]"), F.try_divide(get(0), get(1))).when(t.rlike(two % r"(?:\^|\*\*)"), F.pow(get(0), get(1))).when(F.size(n) > 0, get(0))


def name_downsample(name: Column) -> Column:
    """The power of two at the end of a slice-to-slice file name (``..._<downsample>.stos``); null where it lacks."""
    return power_of_two(F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"_(\d+)(?:\.[A-Za-z]+)?\s*$", 1), F.lit("")).try_cast("double"))
