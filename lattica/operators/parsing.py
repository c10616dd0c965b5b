"""Rows that fail to parse: text tokenized by finite-state machines into typed rows or reasons with offsets.

Both operators run over Arrow batches: the bytes of a batch's texts form one buffer, a machine gives the state after
each byte, and everything else is array arithmetic on the places where the state changes. Nothing runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.automaton import machine
from lattica.functions.mosaic_text import entry_transform
from lattica.sources.tables import load

#: Transform types with the numbers of vp and fp values, fixed values; None: told by fp.
TRANSFORM_TYPES = {
    "LegendrePolynomialTransform_double_2_2_1": (6, 4),
    "Rigid2DTransform_double_2_2": (3, 2),
    "CenteredSimilarity2DTransform_double_2_2": (6, 0),
    "GridTransform_double_2_2": (None, 7),
    "MeshTransform_double_2_2": (None, 8),
}
#: From this magnitude on a number stands for a missing one, fixed value.
NUMBER_LIMIT = 1.79769e308

_GAP, _SIGN, _INT, _DOT, _FRAC, _EXP, _EXPSIGN, _EXPINT, _WORD = range(9)
_NUMBERS = machine(
    9,
    {"space": b" \t\n\v\f\r", "digit": b"0123456789", "sign": b"+-", "dot": b".", "e": b"eE"},
    {(s, "space"): _GAP for s in range(9)}
    | {(_GAP, "digit"): _INT, (_GAP, "sign"): _SIGN, (_GAP, "dot"): _DOT, (_SIGN, "digit"): _INT, (_SIGN, "dot"): _DOT}
    | {(_INT, "digit"): _INT, (_INT, "dot"): _FRAC, (_INT, "e"): _EXP, (_DOT, "digit"): _FRAC, (_FRAC, "digit"): _FRAC, (_FRAC, "e"): _EXP}
    | {(_EXP, "digit"): _EXPINT, (_EXP, "sign"): _EXPSIGN, (_EXPSIGN, "digit"): _EXPINT, (_EXPINT, "digit"): _EXPINT},
    dict.fromkeys(range(9), _WORD),
)

_FIELD, _PLAIN, _QUOTED, _CLOSING, _BROKEN = range(5)
_QUOTES = machine(
    5,
    {"quote": b'"', "comma": b","},
    {(_FIELD, "quote"): _QUOTED, (_FIELD, "comma"): _FIELD, (_PLAIN, "quote"): _BROKEN, (_PLAIN, "comma"): _FIELD}
    | {(_QUOTED, "quote"): _CLOSING, (_QUOTED, "comma"): _QUOTED, (_CLOSING, "quote"): _QUOTED, (_CLOSING, "comma"): _FIELD},
    {_FIELD: _PLAIN, _PLAIN: _PLAIN, _QUOTED: _QUOTED, _CLOSING: _BROKEN, _BROKEN: _BROKEN},
)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a batch's texts and the n+1 offsets of the texts in them; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, drop: np.ndarray | None = None) -> pa.Array:
    """Disjoint ascending slices of a buffer as strings, without the bytes marked in ``drop``."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge[:-1]) > 0
    if drop is not None:
        keep &= ~drop
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = np.append(before[start], before[end[-1]] if len(end) else 0).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes()))


def parse_transforms(texts: pa.Array) -> dict[str, pa.Array]:
    """Columns transform_type, vp, fp, reason, reason_offset of a batch of transform texts.

    A valid text has a null reason; another has null values and the byte offset of its first offence. The types are
    ``TRANSFORM_TYPES``. A null or blank text is an ``invalid_value`` at 0.
    """
    n = len(texts)
    data, offsets = _buffer(texts)
    state = _NUMBERS.run(data, offsets[:-1])
    word = state != _GAP
    opens = np.zeros(len(data), bool)
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    prev = np.concatenate([[False], word[:-1]]) & ~opens if len(data) else word
    start = np.flatnonzero(word & ~prev)
    following = np.concatenate([word[1:] & ~opens[1:], [False]]) if len(data) else word
    end = np.flatnonzero(word & ~following) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    last = state[end - 1] if len(end) else np.zeros(0, np.uint8)
    first = np.searchsorted(row, np.arange(n))
    count = np.diff(np.append(first, len(row)))
    numeric = (last == _INT) | (last == _FRAC) | (last == _EXPINT)
    tokens = _slices(data, start, end)
    values = pc.cast(pc.if_else(pa.array(numeric), tokens, pa.scalar(None, pa.large_string())), pa.float64())
    values = np.array(values.fill_null(np.nan))
    valid = numeric & (np.abs(values) < NUMBER_LIMIT)
    whole = (last == _INT) & (data[start] >= 48) if len(start) else numeric
    two = (end - start) == 2
    is_vp = two & (data[start] == ord("v")) & (data[np.minimum(start + 1, len(data) - 1)] == ord("p")) if len(start) else two
    is_fp = two & (data[start] == ord("f")) & (data[np.minimum(start + 1, len(data) - 1)] == ord("p")) if len(start) else two

    def at(index: np.ndarray, of: np.ndarray, lack: object) -> np.ndarray:
        """``of`` at each row's token ``index``, ``lack`` where the row ends before."""
        there = (index >= 0) & (index < count)
        return np.where(there, of[np.where(there, first + index, 0)], lack) if len(of) else np.full(n, lack)

    zero = np.zeros(n, np.int64)
    heads = pc.if_else(pa.array(count > 0), tokens.take(pa.array(np.minimum(first, max(len(tokens) - 1, 0)))), pa.scalar(None, pa.large_string())) if len(tokens) else pa.nulls(n, pa.large_string())
    kind = np.array(pc.index_in(heads, pa.array(list(TRANSFORM_TYPES), pa.large_string())).fill_null(-1))
    place = np.arange(len(row)) - first[row] if len(row) else zero[:0]
    # The first fp behind the vp count; later ones are no numbers.
    fp_token = np.flatnonzero(is_fp & (place >= 2))
    fp_at = np.full(n, -1)
    fp_at[row[fp_token][::-1]] = place[fp_token][::-1]
    known, has_vp, has_n = kind >= 0, at(zero + 1, is_vp, False).astype(bool), at(zero + 2, whole, False).astype(bool)
    has_fp, has_m = fp_at >= 2, at(np.where(fp_at >= 0, fp_at + 1, -1), whole, False).astype(bool)
    formed = known & has_vp & has_n & has_fp & has_m
    n_vp, n_fp = np.maximum(fp_at - 3, 0), np.maximum(count - fp_at - 2, 0)
    said_vp, said_fp = at(zero + 2, values, -1.0), at(np.where(fp_at >= 0, fp_at + 1, -1), values, -1.0)
    fp_value = lambda k: at(np.where(fp_at >= 0, fp_at + 2 + k, -1), np.where(valid, values, np.nan), np.nan).astype(float)
    want_fp = np.array([v[1] for v in TRANSFORM_TYPES.values()])[kind]
    fixed = np.array([v[0] or -1 for v in TRANSFORM_TYPES.values()], float)[kind]
    with np.errstate(all="ignore"):
        want_vp = np.where(kind == 3, 2 * (fp_value(1) + 1) * (fp_value(2) + 1), np.where(kind == 4, 4 * fp_value(7), fixed))
        bad_fp = (said_fp != n_fp) | (n_fp != want_fp)
        bad_vp = (said_vp != n_vp) | (~np.isnan(want_vp) & (want_vp != n_vp))
    counted = formed & (bad_fp | bad_vp)
    # Numbers that must be valid: all but the type, vp, fp and the two counts.
    number = (place >= 3) & (place != fp_at[row]) & (place != fp_at[row] + 1) if len(row) else numeric
    offence = np.flatnonzero(number & ~valid)
    first_bad = np.full(n, -1)
    first_bad[row[offence][::-1]] = offence[::-1]
    spoiled = formed & ~counted & (first_bad >= 0)

    def where(index: np.ndarray) -> np.ndarray:
        """Byte offset of a row's token, the text's length where it has ended."""
        return np.where((index >= 0) & (index < count), (start[np.minimum(first + np.maximum(index, 0), max(len(start) - 1, 0))] if len(start) else zero) - offsets[:-1], np.diff(offsets))

    shape = np.select([~known, ~has_vp, ~has_n, ~has_fp], [zero, zero + 1, zero + 2, count], fp_at + 1)
    offset = np.select([~formed, counted & bad_vp, counted, spoiled], [where(shape), where(zero + 2), where(fp_at + 1), (start[np.maximum(first_bad, 0)] if len(start) else zero) - offsets[:-1]], -1)
    reason = np.select([~formed, counted, spoiled], ["invalid_value", "column_count", "invalid_value"], "")
    good = reason == ""
    in_vp = number & good[row] & (place < fp_at[row]) if len(row) else numeric
    in_fp = number & good[row] & (place > fp_at[row]) if len(row) else numeric
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[m], minlength=n))]).astype(np.int32)), pa.array(values[m]), mask=pa.array(~good)) for m in (in_vp, in_fp)]
    return {
        "transform_type": pa.array(np.where(good, np.array([*TRANSFORM_TYPES, ""])[kind], ""), pa.string(), mask=~good),
        "vp": lists[0],
        "fp": lists[1],
        "reason": pa.array(reason, pa.string(), mask=good),
        "reason_offset": pa.array(offset.astype(np.int32), pa.int32(), mask=good),
    }


class _Columns(NamedTuple):
    """Comma-separated records of a batch: its bytes, each record's columns and where a quote is out of place."""

    data: np.ndarray
    offsets: np.ndarray
    #: Per column: start and end with its quotes, text without them, and its first byte among the kept ones.
    start: np.ndarray
    end: np.ndarray
    text: pa.Array
    kept_from: np.ndarray
    #: Places of the bytes that the texts keep.
    kept: np.ndarray
    #: Per record: number of columns, its first column, offset of the first misplaced quote or -1.
    count: np.ndarray
    first: np.ndarray
    broken_at: np.ndarray


def _columns(texts: pa.Array) -> _Columns:
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"\r?\n?\z", "")
    n = len(texts)
    data, offsets = _buffer(texts)
    state = _QUOTES.run(data, offsets[:-1])
    length = np.diff(offsets)
    final = np.where(length > 0, state[np.maximum(offsets[1:] - 1, 0)] if len(data) else 0, _FIELD)
    broken, open_end = final == _BROKEN, final == _QUOTED
    row = np.repeat(np.arange(n), length)
    opens = np.zeros(len(data), bool)
    opens[offsets[:-1][length > 0]] = True
    before = np.where(opens, _FIELD, np.concatenate([[_FIELD], state[:-1]])) if len(data) else state
    comma = (data == ord(",")) & (state == _FIELD)
    # Structural bytes: opening quotes, closing ones and the first of each doubled pair, which all end in these states.
    drop = ((before == _FIELD) & (state == _QUOTED)) | (state == _CLOSING)
    broke = np.flatnonzero((state == _BROKEN) & (before != _BROKEN))
    opened = np.flatnonzero((before == _FIELD) & (state == _QUOTED))
    place = np.full(n, -1)
    place[row[opened]] = opened
    place[~open_end] = -1
    place[row[broke]] = broke
    cuts = np.flatnonzero(comma)
    start = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], cuts]), kind="stable")
    count = np.bincount(row[cuts], minlength=n) + 1
    keep = ~drop
    keep[cuts] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return _Columns(data, offsets, start, end, _slices(data, start, end, drop), kept_before[start], np.flatnonzero(keep), count, np.cumsum(count) - count, np.where(broken | open_end, place - offsets[:-1], -1))


def _fields(c: _Columns) -> pa.Array:
    fields = pa.LargeListArray.from_arrays(pa.array(np.append(c.first, len(c.start)).astype(np.int64)), c.text, mask=pa.array(c.broken_at >= 0))
    return fields.cast(pa.list_(pa.string()))


def tokenize_records(texts: pa.Array) -> dict[str, pa.Array]:
    """Columns ``fields`` (array of strings) and ``broken_at`` of a batch of comma-separated records.

    A carriage return at a record's end is no part of it. Quotes around a column are dropped and doubled ones halved. Where
    a quote stands elsewhere or is not closed, ``fields`` is null and ``broken_at`` the byte offset of the offence (of
    the opening quote, if unclosed). A null or empty record has one empty column.
    """
    c = _columns(texts)
    return {"fields": _fields(c), "broken_at": pa.array(c.broken_at.astype(np.int32), pa.int32(), mask=c.broken_at < 0)}


#: Columns of a record by kind, fixed values.
RECORD_COLUMNS = {
    "stos": ["kind", "id", "control_image", "mapped_image", "downsample", "width_height", "transform", "remark"],
    "mosaic": ["kind", "id", "image", "transform", "remark"],
}
_BLANK = r"[ \t\n\v\f\r]"
_WHOLE = rf"^{_BLANK}*\+?0*[1-9][0-9]*{_BLANK}*$"
_TWO_WHOLE = rf"^{_BLANK}*\+?0*[1-9][0-9]*{_BLANK}+\+?0*[1-9][0-9]*{_BLANK}*$"


def parse_records(texts: pa.Array) -> dict[str, pa.Array]:
    """Columns fields, transform_type, vp, fp, reason, reason_offset of a batch of raw records.

    A valid record has a null reason and its transform loaded. The reason of another is the first that fits of quoting,
    column_count and invalid_value, among what is wrong with its columns and with its transform (``parse_transforms``); a
    record of unknown kind is an invalid_value whatever its columns. ``reason_offset`` is the byte offset in the record
    of what gave the reason: the misplaced quote, the first column too many or the record's end, the column or the
    part of the transform that is invalid.
    """
    c = _columns(texts)
    n = len(c.count)
    length = np.diff(c.offsets)

    def column(index: np.ndarray | int) -> tuple[pa.Array, np.ndarray]:
        """Each record's column ``index`` as text, empty where it has none, and its place."""
        index = np.broadcast_to(index, n)
        there = (index >= 0) & (index < c.count)
        at = np.where(there, c.first + index, -1)
        return pc.fill_null(c.text.take(pa.array(at, pa.int64(), mask=~there)), ""), at

    def matches(index: np.ndarray | int, pattern: str) -> np.ndarray:
        return np.array(pc.match_substring_regex(column(index)[0], pattern))

    quoting = c.broken_at >= 0
    kind = np.array(pc.index_in(column(0)[0], pa.array(list(RECORD_COLUMNS), pa.large_string())).fill_null(-1))
    stos = kind == 0
    want = np.array([*map(len, RECORD_COLUMNS.values()), -1])[kind]
    known = ~quoting & (kind >= 0)
    shaped = known & (c.count == want)
    texts_of, at = column(np.where(shaped, np.where(stos, 6, 3), -1))
    made = parse_transforms(texts_of)
    said = np.array(made["reason"].fill_null(""), object)
    # The text of a column keeps some of its bytes: their places lead from an offset in the text to one in the record.
    within = np.array(made["reason_offset"].fill_null(0)).astype(np.int64)
    size = np.array(pc.binary_length(texts_of))
    byte = (c.kept_from[at] if len(c.kept_from) else at) + within
    inside = c.kept[np.minimum(byte, max(len(c.kept) - 1, 0))] if len(c.kept) else byte
    in_transform = np.where(within < size, inside, c.end[at] if len(c.end) else 0)
    spoiled = [~matches(1, _WHOLE), stos & ~matches(4, _WHOLE), stos & ~matches(5, _TWO_WHOLE)]
    bad = [shaped & b for b in spoiled]
    places = [c.start[column(i)[1]] if len(c.start) else np.zeros(n, np.int64) for i in (1, 4, 5)]
    many = c.start[np.where(shaped | ~known | (c.count < want), 0, c.first + want)] if len(c.start) else np.zeros(n, np.int64)
    cases = [
        (quoting, "quoting", c.broken_at + c.offsets[:-1]),
        (~known, "invalid_value", c.offsets[:-1]),
        (~shaped, "column_count", np.where(c.count < want, c.offsets[1:], many)),
        (said == "column_count", "column_count", in_transform),
        *((b, "invalid_value", p) for b, p in zip(bad, places, strict=True)),
        (said == "invalid_value", "invalid_value", in_transform),
    ]
    reason = np.select([x for x, _, _ in cases], [y for _, y, _ in cases], "")
    offset = np.select([x for x, _, _ in cases], [z for _, _, z in cases], 0) - c.offsets[:-1]
    good = reason == ""
    hidden = pa.array(~good)
    blank = lambda x: pc.if_else(hidden, pa.scalar(None, x.type), x)
    return {
        "fields": _fields(c),
        "transform_type": blank(made["transform_type"]),
        "vp": blank(made["vp"]),
        "fp": blank(made["fp"]),
        "reason": pa.array(reason, pa.string(), mask=good),
        "reason_offset": pa.array(np.minimum(offset, length).astype(np.int32), pa.int32(), mask=good),
    }


_DOUBLES = T.ArrayType(T.DoubleType())
_TRANSFORM = [T.StructField("transform_type", T.StringType()), T.StructField("vp", _DOUBLES), T.StructField("fp", _DOUBLES)]
_REASON = [T.StructField("reason", T.StringType()), T.StructField("reason_offset", T.IntegerType())]


def _mapped(df: DataFrame, text: str, parse: Callable[[pa.Array], dict[str, pa.Array]], columns: list[T.StructField], keep: str = "all") -> DataFrame:
    """``df`` without ``text`` and with those ``columns`` that ``parse`` makes of it, batch by batch.

    ``keep`` says which rows leave the batch: all, or those with a null (good) or no null ``reason`` (bad). A column of
    ``df`` gives way to a made one of its name.
    """
    made_names = [f.name for f in columns]
    kept = [f for f in df.schema.fields if f.name != text and f.name not in made_names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = parse(batch.column(batch.schema.get_field_index(text)))
            out = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *(made[c] for c in made_names)], [*names, *made_names])
            yield out if keep == "all" else out.filter(pc.is_null(made["reason"]) if keep == "good" else pc.is_valid(made["reason"]))

    return df.mapInArrow(run, T.StructType([*kept, *columns]))


def with_transforms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``text`` replaced by transform_type, vp, fp, reason and reason_offset (``parse_transforms``)."""
    return _mapped(df, text, parse_transforms, [*_TRANSFORM, *_REASON])


def with_records(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``text`` replaced by fields, transform_type, vp, fp, reason and reason_offset (``parse_records``)."""
    return _mapped(df, text, parse_records, [T.StructField("fields", T.ArrayType(T.StringType())), *_TRANSFORM, *_REASON])


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Callable[[pa.Array], dict[str, pa.Array]]]]:
    """The texts of the three tables as (source_table, record_id, text), each with what parses it."""
    of = lambda table, key, text: load(spark, sf_dir, table).select(F.lit(table).alias("source_table"), F.col(key).alias("record_id"), text.alias("text"))
    return [
        (of("stos_files", "stos_id", F.col("transform_str")), parse_transforms),
        (of("mosaic_tiles", "entry_id", entry_transform(F.col("image_to_transform"))), parse_transforms),
        (of("raw_records", "raw_id", F.col("line_text")), parse_records),
    ]


def _failing(spark: SparkSession, sf_dir: str, columns: list[T.StructField]) -> DataFrame:
    """The failing records of the three tables, once each; only they leave the tokenizer."""
    parts = [_mapped(df, "text", parse, columns, "bad") for df, parse in _texts(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failing(spark, sf_dir, _REASON[:1])


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failing records with the byte offset of what gave the reason."""
    return _failing(spark, sf_dir, _REASON)


def p3_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid transforms of both tables, loaded: one row per record, vp and fp as arrays."""
    parts = [_mapped(df, "text", parse, [*_TRANSFORM], "good") for df, parse in _texts(spark, sf_dir)[:2]]
    return parts[0].unionByName(parts[1]).dropDuplicates(["source_table", "record_id"])


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid raw records, typed, with their transform loaded; a mosaic record has nulls in the columns only stos has, and a number too large for its type is null."""
    raw, parse = _texts(spark, sf_dir)[2]
    good = _mapped(raw, "text", parse, [T.StructField("fields", T.ArrayType(T.StringType())), *_TRANSFORM], "good")
    f = lambda i: F.get("fields", F.lit(i))
    stos = f(0) == "stos"
    size = F.split(F.trim(f(5)), r"\s+")
    return good.select(
        F.col("record_id").alias("raw_id"), f(0).alias("kind"), F.trim(f(1)).try_cast("bigint").alias("id"),
        F.when(stos, f(2)).alias("control_image"), F.when(stos, f(3)).otherwise(f(2)).alias("image"),
        F.when(stos, F.trim(f(4)).try_cast("bigint")).alias("downsample"), F.when(stos, F.get(size, F.lit(0)).try_cast("bigint")).alias("width"), F.when(stos, F.get(size, F.lit(1)).try_cast("bigint")).alias("height"),
        "transform_type", "vp", "fp", F.when(stos, f(7)).otherwise(f(4)).alias("remark"),
    ).dropDuplicates(["raw_id"])
