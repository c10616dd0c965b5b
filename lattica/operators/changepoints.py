"""Unit changes in the history of a source: exact penalised changepoint search on log values, over known factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.units import UNIT_NM, written_number
from lattica.operators.units import p5_found, with_quantities
from lattica.sources.tables import load, materialize

#: Cost of a change, in units of half a squared deviation: low, as sources may change unit from record to record.
PENALTY = 0.7
#: Records of a piece at most.
PIECE = 1024


def advance(best: np.ndarray, cost: np.ndarray, penalty: float) -> np.ndarray:
    """One record further: ``best[..., k]`` is the least cost so far that ends in level k, ``cost[..., k]`` the record's own."""
    return np.minimum(best, best.min(axis=-1, keepdims=True) + penalty) + cost


def piece_matrix(cost: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """For each piece the least cost from level e before its first record to level k at its last, all pieces in step.

    ``cost`` is (pieces, records, levels), of which the first ``length`` records of a piece count.
    """
    pieces, steps, k = cost.shape
    best = np.where(np.eye(k, dtype=bool), 0.0, penalty)[None].repeat(pieces, 0) + cost[:, :1]
    for t in range(1, steps):
        live = t < length
        best[live] = advance(best[live], cost[live, t][:, None], penalty)
    return best


def levels_of(cost: np.ndarray, length: np.ndarray, entry: np.ndarray, last: np.ndarray, penalty: float) -> np.ndarray:
    """The level of each record of each piece, given the least costs ``entry`` before it and the level ``last`` it ends in."""
    pieces, steps, k = cost.shape
    back = np.zeros((pieces, steps, k), np.int8)
    best = entry.copy()
    every = np.arange(k)
    for t in range(steps):
        jump = best.argmin(axis=1)
        stay = best <= best.min(axis=1, keepdims=True) + penalty
        back[:, t] = np.where(stay, every, jump[:, None])
        live = t < length
        best[live] = advance(best[live], cost[live, t], penalty)
    out = np.zeros((pieces, steps), np.int64)
    state = last.copy()
    for t in range(steps - 1, -1, -1):
        out[:, t] = state
        state = np.where(t < length, back[np.arange(pieces), t, state], state)
    return out


def _padded(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(lists.value_lengths()).astype(np.int64) // k
    flat = np.array(lists.flatten()).reshape(-1, k)
    cost = np.zeros((len(lengths), int(lengths.max(initial=1)), k))
    row = np.repeat(np.arange(len(lengths)), lengths)
    cost[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return cost, lengths


def segment(df: DataFrame, levels: int, penalty: float = PENALTY) -> DataFrame:
    """Adds ``level`` to rows (source, at, id, costs array<double>): the levels of least total cost plus ``penalty`` per change.

    The search is exact for each source's whole history, however long: rows are range-sorted by source and time and cut
    into pieces; a piece's least costs from level to level form a small matrix, and these compose by minimum and sum.
    Only matrices are carried along a source, forwards for the costs and backwards for the levels; then every piece is
    solved on its own. A source with a third of all rows so costs a third of the matrices, a thousandth of its rows.
    """
    k = levels
    rows = df.select("source", "at", "id", "costs").repartitionByRange("source", "at", "id").sortWithinPartitions("source", "at", "id")
    kinds = dict(df.dtypes)
    key = f"source {kinds['source']}, run int, piece int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column(0).dictionary_encode()
            code = np.array(source.indices.fill_null(-1))
            head = np.flatnonzero(np.diff(code, prepend=code[0] - 1) != 0)
            bounds = sorted({*head.tolist(), *(b for a, z in zip(head.tolist(), [*head[1:].tolist(), len(code)], strict=True) for b in range(a, z, PIECE)), len(code)})
            offsets = pa.array(np.array(bounds, np.int32))
            costs = batch.column(3).flatten()
            ids = pa.ListArray.from_arrays(offsets, batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32) * k), costs)
            matrix = piece_matrix(*_padded(flat, k), penalty).reshape(len(ids), -1)
            n = len(ids)
            made = [batch.column(0).take(pa.array(bounds[:-1])), pa.array(np.full(n, run, np.int32)), pa.array(np.arange(piece, piece + n, dtype=np.int32)), ids, flat, pa.array(list(matrix), pa.list_(pa.float64()))]
            piece += n
            yield pa.RecordBatch.from_arrays(made, ["source", "run", "piece", "ids", "costs", "matrix"])

    pieces = materialize(rows.mapInArrow(cut, f"{key}, ids array<{kinds['id']}>, costs array<double>, matrix array<double>"))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cost = object(), np.zeros(k)
        for batch in batches:
            entry, came = [], []
            for source, matrix in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if source != last:
                    last, cost = source, np.zeros(k)
                total = cost[:, None] + np.array(matrix).reshape(k, k)
                entry.append(cost)
                came.append(total.argmin(axis=0).astype(np.int32))
                cost = total.min(axis=0)
                cost = cost - cost.min()
                # The level a source would end in, were this its last piece.
                came[-1] = np.append(came[-1], cost.argmin()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(entry, pa.list_(pa.float64())), pa.array(came, pa.list_(pa.int32()))], ["source", "run", "piece", "entry", "came"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), 0
        for batch in batches:
            out = []
            for source, came in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if source != last:
                    last, state = source, came[k]
                out.append(state)
                state = came[state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int32())], ["source", "run", "piece", "entry", "last"])

    small = pieces.select("source", "run", "piece", "matrix").repartition("source").sortWithinPartitions("source", "run", "piece")
    ahead = small.mapInArrow(forward, f"{key}, entry array<double>, came array<int>")
    back = ahead.repartition("source").sortWithinPartitions("source", F.desc("run"), F.desc("piece")).mapInArrow(backward, f"{key}, entry array<double>, last int")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cost, length = _padded(batch.column(4), k)
            entry = np.array(batch.column(5).flatten()).reshape(-1, k)
            level = levels_of(cost, length, entry, np.array(batch.column(6)).astype(np.int64), penalty)
            inside = np.arange(level.shape[1]) < length[:, None]
            row = pa.array(np.repeat(np.arange(len(length)), length))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(3).flatten(), pa.array(level[inside].astype(np.int32))], ["source", "id", "level"])

    joined = pieces.select("source", "run", "piece", "ids", "costs").join(back.withColumnRenamed("source", "s"), ["run", "piece"]).select("source", "run", "piece", "ids", "costs", "entry", "last")
    return joined.mapInArrow(solve, T.StructType([df.schema["source"], T.StructField("id", df.schema["id"].dataType), T.StructField("level", T.IntegerType())]))


#: Levels of a length: how it may have been written. Fixed values.
WRITTEN_IN = ("pixels", "full_pixels", "å", "nm", "µm", "mm", "cm", "m")
#: Levels of a downsample: as a factor, its inverse, a percentage, a pyramid level. Fixed values.
DOWNSAMPLES = ("factor", "inverse", "percent", "level")
#: Log deviations from a source's usual value: least and largest one taken as its standard deviation.
SPREAD = (0.1, 1.0)
#: Cost of a level that a record can't have.
NEVER = 1e6


def _history(rows: DataFrame) -> DataFrame:
    """Adds ``usual`` and ``spread`` to rows (source, base): median and normal spread of ``base`` in the source's history."""
    found = F.percentile_approx("base", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias("q")
    per = rows.groupBy("source").agg(found).select(F.col("source").alias("of"), F.get("q", F.lit(1)).alias("usual"), F.greatest(F.lit(SPREAD[0]), F.least(F.lit(SPREAD[1]), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / 1.349)).alias("spread"))
    return rows.join(per, rows["source"] == per["of"]).drop("of")


def _cost(z: F.Column, expected: list[F.Column]) -> F.Column:
    """Half squared deviations of ``z`` from what each level makes one expect; a zero, which has no log, fits every level alike."""
    one = lambda e: F.when(z.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.pow((z - e) / F.col("spread"), 2.0) / 2, F.lit(NEVER)))
    return F.array(*[one(e) for e in expected])


def written_downsamples(stos: DataFrame) -> DataFrame:
    """(stos_id, source, written_in, factor): how each record's downsample was written, by its source's history alone.

    What is written is the number in the text, a ratio or power worked out. A text without a number is left out.
    """
    q = stos.select("stos_id", F.coalesce("stos_dir", F.lit("")).alias("source"), F.col("recorded_at").alias("at"), written_number(F.col("downsample")).alias("number")).filter("number >= 0")
    z = F.when(F.col("number") > 0, F.ln("number"))
    known = _history(q.withColumn("base", z))
    u, hundred = F.col("usual"), float(np.log(100.0))
    level = F.ln(F.greatest(u / float(np.log(2.0)), F.lit(0.05)))
    rows = known.select("source", "at", F.struct("stos_id", "number").alias("id"), _cost(z, [u, -u, F.lit(hundred) - u, level]).alias("costs"))
    found = segment(rows, len(DOWNSAMPLES))
    n = F.col("id.number")
    value = F.when(F.col("level") == 0, n).when(F.col("level") == 1, F.try_divide(F.lit(1.0), n)).when(F.col("level") == 2, F.try_divide(F.lit(100.0), n)).otherwise(F.pow(F.lit(2.0), n))
    return found.select("id.stos_id", "source", F.get(F.array(*[F.lit(x) for x in DOWNSAMPLES]), "level").alias("written_in"), value.alias("factor"))


def written_lengths(quantities: DataFrame) -> DataFrame:
    """(stos_id, written, source, written_in, values_px) of lengths (stos_id, written, folder, at, values, factor, pixel_nm), by history alone; they are read twice.

    ``values`` are the numbers that one text gives in one unit, and ``written`` says which text; a folder and text have one
    history, of the mean log of the numbers. The usual length is its median, read as pixels at the record's factor; a level
    is that length as written in one of ``WRITTEN_IN``, and shifts between levels mark changes of unit. Without a pixel
    size only pixels are possible.
    """
    logs = F.filter(F.transform("values", lambda v: F.when(v != 0, F.ln(F.abs(v)))), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(logs, F.lit(0.0), lambda a, v: a + v), F.size(logs))
    kept = quantities.withColumn("z", mean).withColumn("source", F.concat_ws(" ", "written", "folder"))
    lds, lpx = F.ln("factor"), F.ln(F.when(F.col("pixel_nm") > 0, F.col("pixel_nm")))
    known = _history(kept.withColumn("base", F.col("z") + lds))
    of = lambda lds, lpx: [-lds, F.lit(0.0), *[lpx - float(np.log(UNIT_NM[u])) for u in WRITTEN_IN[2:]]]
    carried = F.struct("stos_id", "written", "folder", "values", lds.alias("lds"), lpx.alias("lpx"))
    rows = known.select("source", "at", carried.alias("id"), _cost(F.col("z"), [F.col("usual") + f for f in of(lds, lpx)]).alias("costs"))
    found = segment(rows, len(WRITTEN_IN))
    factor = F.exp(-F.get(F.array(*of(F.col("id.lds"), F.col("id.lpx"))), "level"))
    pixels = F.transform("id.values", lambda v: v * factor)
    whole = F.transform(pixels, lambda v: F.round(F.when(F.abs(v) < 9e18, v)).cast("bigint"))
    return found.select("id.stos_id", "id.written", F.col("id.folder").alias("source"), F.get(F.array(*[F.lit(x) for x in WRITTEN_IN]), "level").alias("written_in"), whole.alias("values_px"))


#: Quantities of a text, in its order. Fixed values.
WRITTEN = {"mapped_image_dim": ("mapped_width", "mapped_height"), "transform_str": ("transform_x",)}


def p5_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every readable quantity of every record was written, and its value in full-resolution pixels, by histories alone.

    What a record states of its units isn't used: a folder's records in order of time are the history. The downsample comes
    first; the lengths are then read with the factor found. A record whose downsample has no number takes its
    folder's usual factor. A quantity without a finite number has no row.
    """
    stos = load(spark, sf_dir, "stos_files")
    factors = materialize(written_downsamples(stos.select("stos_id", "stos_dir", "recorded_at", "downsample").dropDuplicates(["stos_id"])))
    usual = factors.groupBy("source").agg(F.percentile_approx("factor", 0.5, 1000).alias("usual_factor")).withColumnRenamed("source", "s_source")
    n = F.size("dims")
    q = with_quantities(stos).select("stos_id", F.coalesce("stos_dir", F.lit("")).alias("folder"), "recorded_at", "pixel_nm", F.when(n >= 2, F.slice("dims", n - 1, 2)).alias("dims"), "x").dropDuplicates(["stos_id"])
    texts = {"mapped_image_dim": F.col("dims"), "transform_str": F.array("x")}
    long = q.select("stos_id", "folder", F.col("recorded_at").alias("at"), "pixel_nm", F.explode(F.array(*[F.struct(F.lit(k).alias("written"), v.alias("values")) for k, v in texts.items()])).alias("r")).select("*", "r.written", "r.values").drop("r")
    own = factors.select(F.col("stos_id").alias("f_id"), "factor")
    finite = long.filter(F.col("values").isNotNull() & F.forall("values", lambda v: F.coalesce(F.abs(v) < 1.79769e308, F.lit(False))))
    with_factor = finite.join(own, finite["stos_id"] == own["f_id"], "left").join(usual, finite["folder"] == usual["s_source"], "left")
    used = F.coalesce(F.when(F.col("factor") > 0, F.col("factor")), "usual_factor", F.lit(1.0))
    lengths = written_lengths(materialize(with_factor.select("stos_id", "written", "folder", "at", "values", "pixel_nm", used.alias("factor"))))
    named = F.arrays_zip(F.coalesce(*[F.when(F.col("written") == k, F.array(*[F.lit(x) for x in v])) for k, v in WRITTEN.items()]).alias("n"), F.col("values_px").alias("v"))
    lengths = lengths.select("stos_id", "source", "written_in", F.explode(named).alias("r")).select("stos_id", F.col("r.n").alias("field_name"), "source", "written_in", F.col("r.v").alias("value_px"))
    down = factors.select("stos_id", F.lit("downsample").alias("field_name"), "source", "written_in", F.round(F.when(F.col("factor") < 9e18, F.col("factor"))).cast("bigint").alias("value_px"))
    return down.unionByName(lengths)


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field the quantities that records state (``p5_found``), those the method has, and those on which both agree within a pixel."""
    stated = p5_found(spark, sf_dir).withColumnRenamed("value_px", "stated_px")
    made = p5_method(spark, sf_dir).select("stos_id", "field_name", "value_px")
    both = stated.join(made, ["stos_id", "field_name"], "left")
    return both.groupBy("field_name").agg(F.count("*").alias("n_stated"), F.count("value_px").alias("n_method"), F.count_if(F.abs(F.col("value_px") - F.col("stated_px")) <= 1).alias("n_agree"))
