"""Far too many small files: sorted runs of their records, merged k ways per key range into files of a target size."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.paths import trimmed, unslashed
from lattica.sources.tables import load, materialize

TARGET_BYTES = 128 * 1024 * 1024
#: Rows that a task sorts into one run, and rows of a key range, on average; both are held by one task at a time.
RUN_ROWS = 200_000
RANGE_ROWS = 200_000
#: Key ranges at most; beyond, ranges hold more rows.
MAX_RANGES = 8192
#: Keys sampled per range for its bounds.
SAMPLES_PER_RANGE = 16


def tile_key(path: F.Column) -> F.Column:
    """Level folder and file name of a tile path, ignoring case, slash style and surrounding white space; null for a null or blank path."""
    clean = F.lower(trimmed(F.regexp_replace(unslashed(trimmed(path)), "/{2,}", "/")))
    return F.nullif(F.substring_index(clean, "/", -2), F.lit(""))


def sorted_runs(files: DataFrame, rows: int = RUN_ROWS) -> DataFrame:
    """Sorted runs of tile files (tile, level, file_id, written_at, n_bytes and any more columns): adds run_no, place and ``left``.

    Each task sorts its files by tile, newest first, in runs of at most ``rows``. Within a run a row that repeats another
    is dropped, and of each tile only the newest non-empty file can be current: the others are ``left`` and have no
    place, so however often a tile was written it has one row per run to merge. A file without a tile or time of writing,
    or of no bytes, is ``left``.
    """
    names = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("run_no", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("left", T.BooleanType())])

    def made(held: list[pa.RecordBatch], run_no: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        good = pc.and_(pc.fill_null(pc.greater(table["n_bytes"], 0), False), pc.and_(pc.is_valid(table["written_at"]), pc.is_valid(table["tile"])))
        table = table.append_column("bad", pc.invert(good))
        table = table.take(pc.sort_indices(table, [("tile", "ascending"), ("bad", "ascending"), ("written_at", "descending"), ("file_id", "descending")]))
        fresh = {c: _changes(table[c]) for c in ("tile", "bad", "written_at", "file_id")}
        whole = fresh["tile"] | fresh["bad"] | fresh["written_at"] | fresh["file_id"]
        left = np.array(table["bad"]) | ~fresh["tile"]
        table, left = table.select(names).filter(pa.array(whole)), left[whole]
        place = np.cumsum(~left) - 1
        table = table.append_column("run_no", pa.array(np.full(len(left), run_no))).append_column("place", pa.array(place.astype(np.int32), mask=left)).append_column("left", pa.array(left))
        yield from table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_no, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from made(held, run_no)
                run_no, held, n = run_no + 1, [], 0
        if n:
            yield from made(held, run_no)

    return files.mapInArrow(run, schema)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; a null equals a null, the first value differs."""
    if not len(column):
        return np.zeros(0, bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(a, b), False)
    return np.append(True, np.array(pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b)))))


def range_bounds(runs: DataFrame, rows: int = RANGE_ROWS) -> list[str]:
    """Tiles at which key ranges of about ``rows`` rows begin, from a sample of each run at equal steps.

    The sample is about ``SAMPLES_PER_RANGE`` tiles a range, so at most ``MAX_RANGES`` times that reach the driver.
    """
    alive = runs.filter("not left")
    n = alive.count()
    ranges = min(MAX_RANGES, -(-n // rows))
    if ranges < 2:
        return []
    step = max(1, n // (ranges * SAMPLES_PER_RANGE))
    # Each run's steps begin at another place, so that short runs are met in proportion too.
    sample = sorted(r.tile for r in alive.filter(F.pmod(F.col("place") + F.pmod(F.xxhash64("run_no"), F.lit(step)), F.lit(step)) == 0).select("tile").toLocalIterator())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def merge_runs(runs: DataFrame, bounds: list[str]) -> DataFrame:
    """The k-way merge of ``sorted_runs`` per key range: their rows in order, with range_no, ``current`` and bytes_before.

    Runs are cut at ``bounds`` and each range's pieces go to one task, which merges them through a heap of their heads. Of a
    tile the first row is current, as it is the newest; a row that repeats the one before is dropped. In the same pass the
    bytes of the level's earlier tiles within the range are summed for each current row.
    """
    names = [c for c in runs.columns if c not in ("place", "left")]
    kept = [runs.schema[c] for c in names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tiles, out = batch.column(names.index("tile")).to_pylist(), np.zeros(n, np.int32)
            heads = np.flatnonzero(np.diff(np.array(batch.column(names.index("run_no"))), prepend=-1)).tolist()
            for i, end in zip(heads, [*heads[1:], n], strict=True):
                while i < end:
                    r = bisect_right(bounds, tiles[i])
                    j = end if r == len(bounds) else bisect_left(tiles, bounds[r], i, end)
                    out[i:j] = r
                    i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "range_no"])

    def merged(table: pa.Table, range_no: int) -> Iterator[pa.RecordBatch]:
        tiles, files = table["tile"].to_pylist(), table["file_id"].fill_null(np.iinfo(np.int64).min).to_pylist()
        written = np.array(table["written_at"].cast(pa.int64()))
        fall = np.array([a > b for a, b in zip(tiles[:-1], tiles[1:], strict=True)], bool)
        heads = [0, *(np.flatnonzero(fall | (np.diff(np.array(table["run_no"])) != 0)) + 1).tolist()]
        newest, ids = (-written).tolist(), [~f for f in files]
        pieces = [zip(tiles[i:j], newest[i:j], ids[i:j], range(i, j), strict=True) for i, j in zip(heads, [*heads[1:], len(tiles)], strict=True)]
        order = np.fromiter((row[3] for row in heapq.merge(*pieces)), np.int64, len(tiles))
        table = table.take(pa.array(order))
        fresh = {c: _changes(table[c]) for c in ("tile", "level", "written_at", "file_id")}
        whole = fresh["tile"] | fresh["written_at"] | fresh["file_id"]
        current = fresh["tile"]
        size = np.where(current, np.array(table["n_bytes"].fill_null(0)), 0).astype(np.int64)
        before = np.cumsum(size) - size
        starts = np.flatnonzero(fresh["level"])
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(before))))
        table = table.append_column("range_no", pa.array(np.full(len(order), range_no, np.int32))).append_column("current", pa.array(current)).append_column("bytes_before", pa.array(before, mask=~current))
        yield from table.filter(pa.array(whole)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One range comes to a task, unless there are fewer partitions than ranges.
        held: dict[int, list[pa.RecordBatch]] = defaultdict(list)
        for batch in batches:
            ranges = np.array(batch.column(len(names)))
            for r in np.unique(ranges).tolist():
                held[r].append(batch.filter(pa.array(ranges == r)))
        for r in sorted(held):
            yield from merged(pa.Table.from_batches(held.pop(r)).combine_chunks().select(names), r)

    ranged = runs.filter("not left").select(*names).mapInArrow(cut, T.StructType([*kept, T.StructField("range_no", T.IntegerType())]))
    schema = T.StructType([*kept, T.StructField("range_no", T.IntegerType()), T.StructField("current", T.BooleanType()), T.StructField("bytes_before", T.LongType())])
    return ranged.repartitionById(len(bounds) + 1, "range_no").mapInArrow(run, schema)


def roll_by_bytes(merged: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """The current rows of ``merge_runs`` with file_no and byte_offset: a new file of the level whenever ``target`` bytes are full.

    A tile goes to the file in which it begins, so files exceed the target by less than one tile, and the last of a level
    is smaller. Only the bytes per range and level, a few numbers a task, are summed across ranges.
    """
    kept = materialize(merged.filter("current"))
    totals = kept.groupBy("level", "range_no").agg(F.sum(F.coalesce(F.col("n_bytes"), F.lit(0))).alias("range_bytes"))
    earlier = F.coalesce(F.sum("range_bytes").over(Window.partitionBy("level").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("level").alias("_l"), F.col("range_no").alias("_r"), earlier.alias("range_start"))
    joined = kept.join(starts, F.col("level").eqNullSafe(F.col("_l")) & (F.col("range_no") == F.col("_r")))
    at = F.col("range_start") + F.col("bytes_before")
    return joined.select(*[c for c in kept.columns if c not in ("run_no", "range_no", "current", "bytes_before")], F.floor(at / F.lit(target)).cast("bigint").alias("file_no"), at.alias("byte_offset"))


def tile_files(files: DataFrame, *more: str) -> DataFrame:
    """Tile files with their tile and level (``tile_key``), file_id, written_at, n_bytes and ``more`` columns."""
    tile = tile_key(F.col("output_file_full_path"))
    return files.select(tile.alias("tile"), F.substring_index(tile, "/", 1).alias("level"), "file_id", "written_at", "n_bytes", *more)


def consolidation(files: DataFrame, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Written sorted runs of ``tile_files``, and their merge."""
    runs = materialize(sorted_runs(files, run_rows))
    return runs, merge_runs(runs, range_bounds(runs, range_rows))


def left_out(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """(file_id) of the files that no consolidated file holds: what a run or the merge has left, each once."""
    return runs.filter("left").select("file_id").unionByName(merged.filter("not current").select("file_id")).distinct()


_CORNERS = ["top_left", "top_right", "bottom_left", "bottom_right"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the merge leaves out: all but the current file of each tile."""
    return left_out(*consolidation(tile_files(load(spark, sf_dir, "tileset_files"))))


def consolidated(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One row per current tile: the consolidated file (level, file_no) that holds it and its place there."""
    return roll_by_bytes(consolidation(tile_files(load(spark, sf_dir, "tileset_files"), *more))[1])


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir, "content_crc").select("level", "file_no", "byte_offset", "tile", "file_id", "n_bytes", "content_crc")


def p4_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range metadata of the consolidated files: first and last tile, tiles and bytes."""
    return consolidated(spark, sf_dir).groupBy("level", "file_no").agg(F.min("tile").alias("first_tile"), F.max("tile").alias("last_tile"), F.count("*").alias("n_tiles"), F.sum("n_bytes").alias("n_bytes"))


def p4_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corner path of a current tile with the place its tile has now; nulls where no such tile exists."""
    placed = materialize(consolidated(spark, sf_dir, *_CORNERS))
    corner = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("corner"), tile_key(F.col(n)).alias("key")) for n in _CORNERS]), lambda x: x["key"].isNotNull())).alias("c")
    asked = placed.select("file_id", corner).select("file_id", "c.corner", F.col("c.key").alias("corner_tile"))
    places = placed.select(F.col("tile").alias("corner_tile"), F.col("file_id").alias("corner_file_id"), F.col("level").alias("corner_level"), F.col("file_no").alias("corner_file_no"), F.col("byte_offset").alias("corner_offset"))
    return asked.join(places, "corner_tile", "left")
