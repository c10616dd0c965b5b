"""Percentiles of very large numeric columns with bounded rank error, from summaries that combine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import summaries as S
from lattica.sources.tables import load

#: Placeholder for a missing value, and the first value too large to count, fixed value.
VALUE_LIMIT = 1.79769e308
PERCENTS = (1, 25, 50, 75, 90, 99)
#: Rows of a day and group in one task at most, on average: hot days are cut into that many by hash.
SALTS = 16


def _summary_type(keys: list[T.StructField]) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    return T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("gap", T.LongType()), T.StructField("vals", T.ArrayType(T.DoubleType())), T.StructField("lo", longs), T.StructField("hi", longs)])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that arrive sorted by ``keys``, in tables of at least ``least`` rows, with each row's group number.

    A group longer than that still comes in pieces no larger than a table: the caller merges pieces of equal keys.
    """

    def numbered(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            index = np.array(codes.indices.fill_null(-1))
            change |= np.diff(index, prepend=index[:1] - 1) != 0
        return np.cumsum(change) - 1

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        group = numbered(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut == 0:
            cut = table.num_rows
        yield table.slice(0, cut), group[:cut]
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if rows:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _packed(table: pa.Table, keys: list[str], group: np.ndarray, tuples: S.Tuples, n: np.ndarray) -> pa.RecordBatch:
    groups = len(n)
    g, v, lo, hi = tuples
    offsets = pa.array(np.searchsorted(g, np.arange(groups + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, lo, hi)]
    first = pa.array(np.searchsorted(group, np.arange(groups)))
    key_columns = [table.column(k).combine_chunks().take(first) for k in keys]
    return pa.RecordBatch.from_arrays([*key_columns, pa.array(n), pa.array(S.gaps(tuples, groups)), *lists], [*keys, "n", "gap", "vals", "lo", "hi"])


def summarize(df: DataFrame, keys: list[str], period: str, value: list[str], once: str, eps: float) -> DataFrame:
    """Summaries per ``keys`` + measure + ``period``: n, gap and the tuples (vals, lo, hi); a row per hash part of a period.

    ``once`` identifies a measurement: rows that repeat it count once. Only finite values from 0 to below ``VALUE_LIMIT``
    count. Rows are spread by keys, period and a hash of ``once``, so repetitions meet and a hot group is cut into
    ``SALTS`` parts; sorted within the task (spilling), they are read as a stream and never gathered by group.
    Each part gives up ranks of at most eps * its n.
    """
    part = F.pmod(F.xxhash64(once), F.lit(SALTS)).cast("int").alias("part")
    spread = df.select(*keys, period, once, part, *value).repartition(*keys, period, "part")
    by = [*keys, period, "part"]
    kept = [df.schema[k] for k in [*keys, period]]
    schema = _summary_type([*kept, T.StructField("measure", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for table, group in _runs(batches, by, 1 << 16):
            ident = table.column(once).combine_chunks()
            fresh = np.array(pc.fill_null(ident, 0))
            null = np.array(ident.is_null())
            # A null identifier names no measurement that could be repeated.
            same = np.append([False], (np.diff(group) == 0) & (fresh[1:] == fresh[:-1]) & ~null[1:] & ~null[:-1])
            head, tail = ([table.column(c)[i].as_py() for c in [*by, once]] for i in (0, table.num_rows - 1))
            same[0] = head == before and head[-1] is not None
            before = tail
            for m in value:
                v = np.array(table.column(m).combine_chunks().cast(pa.float64()).fill_null(np.nan))
                good = np.flatnonzero(~same & (v >= 0) & (v < VALUE_LIMIT))
                g, x = group[good], v[good] + 0.0
                order = np.lexsort((x, g))
                g, x = g[order], x[order]
                rank = np.arange(len(g)) - np.searchsorted(g, g) + 1
                n = np.bincount(g, minlength=int(group[-1]) + 1)
                tuples = S.compress((g, x, rank, rank.copy()), eps * n)
                out = _packed(table, [*keys, period], group, tuples, n)
                yield from pa.Table.from_batches([out]).add_column(len(keys) + 1, "measure", pa.array(np.full(len(n), m))).filter(pa.array(n > 0)).to_batches()

    return spread.sortWithinPartitions(*by, once).mapInArrow(run, schema)


def combine(parts: DataFrame, keys: list[str], eps: float, spread_by: str | None = None) -> DataFrame:
    """Merged summaries per ``keys`` from partial ones, again in the same form: results combine in any order and as often as wanted.

    The rank ranges of merged tuples add up those of the parts, so the gap of a result is measured, not assumed. Each
    merge may add eps * n to it. A task streams its rows in key order, and a group of more tuples than a batch is
    merged piece by piece. ``spread_by`` only names a further column to cut groups by, for a first round of many parts.
    """
    by = [*keys, *([spread_by] if spread_by else [])]
    schema = _summary_type([parts.schema[k] for k in by])

    def folded(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        lists = table.column("vals").combine_chunks()
        counts = np.array(pc.list_value_length(lists)).astype(np.int64)
        flat = [np.array(pc.list_flatten(table.column(c).combine_chunks())) for c in ("vals", "lo", "hi")]
        source = np.repeat(np.arange(len(counts)), counts)
        n = np.bincount(group, weights=np.array(table.column("n")), minlength=int(group[-1]) + 1).astype(np.int64)
        return _packed(table, by, group, S.compress(S.merge(group[source], source, *flat), eps * n), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        alike = lambda a, b: all(a.column(k)[a.num_rows - 1] == b.column(k)[0] or (a.column(k)[a.num_rows - 1].as_py() is None and b.column(k)[0].as_py() is None) for k in by)
        for table, group in _runs(batches, by, 1 << 12):
            out = folded(table, group)
            if held is not None and alike(held, out):
                both = pa.Table.from_batches([held, out.slice(0, 1)])
                head = folded(both, np.zeros(2, np.int64))
                out = pa.Table.from_batches([head, out.slice(1)]).combine_chunks().to_batches()[0]
            elif held is not None:
                yield held
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    return parts.select(*by, "n", "gap", "vals", "lo", "hi").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def percentiles(merged: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """A column p01, p25, ... per percent from merged summaries, and max_rank_error as a share of n: measured, for the ranks asked."""
    schema = T.StructType([*[merged.schema[k] for k in keys], T.StructField("n", T.LongType()), *[T.StructField(f"p{p:02d}", T.DoubleType()) for p in percents], T.StructField("max_rank_error", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            counts = np.array(pc.list_value_length(get("vals"))).astype(np.int64)
            ends = np.cumsum(counts)
            flat = [np.array(pc.list_flatten(get(c))) for c in ("vals", "lo", "hi")]
            n = np.array(get("n"))
            found = [S.value_at((None, *flat), ends - counts, ends, np.maximum(1, np.ceil(p / 100 * n))) for p in percents]
            worst = np.max([e for _, e in found], axis=0) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*[get(k) for k in keys], get("n"), *[pa.array(v) for v, _ in found], pa.array(worst)], schema.names)

    return merged.mapInArrow(run, schema)


GROUP = ["section_no", "channel_name", "bpp"]
#: Share of n that a summary may give up at each of its steps: day, month, all. Together they leave under half a percent.
EPS_STEP = 0.0015


def daily_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = load(spark, sf_dir, "image_stats").select(*GROUP, F.to_date("measured_at").alias("day"), "stat_id", "px_median", "px_std")
    return summarize(stats, GROUP, "day", ["px_median", "px_std"], "stat_id", EPS_STEP)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of px_median and px_std per group, from daily summaries merged by month and then over all."""
    keys = [*GROUP, "measure"]
    monthly = combine(daily_summaries(spark, sf_dir).withColumn("month", F.trunc("day", "month")), keys, EPS_STEP, "month")
    return percentiles(combine(monthly, keys, EPS_STEP), keys)


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept daily results: the summaries per group, measure and day of measured_at, ready to be combined."""
    return combine(daily_summaries(spark, sf_dir), [*GROUP, "measure", "day"], EPS_STEP)


def p2_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group and measure the number of values, and whether every percentile's true rank lies within 1 % of the one asked.

    The true ranks are counted over all values: each looks up its group's percentiles, which are one row.
    """
    found = p2_percentiles(spark, sf_dir)
    names = [f"p{p:02d}" for p in PERCENTS]
    stats = load(spark, sf_dir, "image_stats").select("stat_id", *GROUP, "px_median", "px_std").distinct()
    pair = lambda m: F.struct(F.lit(m).alias("measure"), F.col(m).alias("v"))
    values = stats.select(*GROUP, F.explode(F.array(pair("px_median"), pair("px_std"))).alias("m")).select(*GROUP, "m.measure", "m.v").filter(f"v >= 0 and v < {VALUE_LIMIT!r} and not isnan(v)")
    f = found.select(*[F.col(k).alias(f"f_{k}") for k in [*GROUP, "measure"]], *names)
    same = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in [*GROUP, "measure"]]
    joined = values.join(f, same[0] & same[1] & same[2] & same[3])
    counted = joined.groupBy(*GROUP, "measure").agg(F.count("*").alias("n"), *[F.count_if(F.col("v") < F.col(n)).alias(f"{n}_less") for n in names], *[F.count_if(F.col("v") <= F.col(n)).alias(f"{n}_upto") for n in names])
    ok = F.lit(True)
    for p, n in zip(PERCENTS, names, strict=True):
        rank = F.greatest(F.ceil(F.col("n") * p / 100), F.lit(1))
        ok = ok & (F.col(f"{n}_less") + 1 - rank <= F.col("n") * 0.01) & (rank - F.col(f"{n}_upto") <= F.col("n") * 0.01)
    return counted.select(*GROUP, "measure", "n", ok.alias("within"))
