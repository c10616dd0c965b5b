"""References to records that do not exist, or did not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.mosaic_text import entry_file
from lattica.functions.paths import is_blank, resolved_path
from lattica.sources.tables import load

_STOS_FIELDS = ("control_image_full_path", "mapped_image_full_path", "control_mask_full_path")


def stos_references(stos: DataFrame) -> DataFrame:
    """Long form (source_table, record_id, field_name, key, at) of the image and mask paths of slice-to-slice records."""
    fields = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("path")) for f in _STOS_FIELDS]
    long = stos.select(F.col("stos_id").alias("record_id"), "stos_dir", F.col("recorded_at").alias("at"), F.explode(F.filter(F.array(*fields), lambda x: ~is_blank(x["path"]))).alias("f"))
    return long.select(F.lit("stos_files").alias("source_table"), "record_id", "f.field_name", resolved_path(F.col("f.path"), F.col("stos_dir")).alias("key"), "at")


def mosaic_references(mosaic: DataFrame) -> DataFrame:
    """Long form of the tiles that mosaic entries name: the entry's file name in ``tile_dir``."""
    named = mosaic.select("entry_id", "tile_dir", F.explode(F.filter(F.array(entry_file(F.col("image_to_transform"))), lambda n: n != "")).alias("name"), "recorded_at")
    key = resolved_path(F.concat_ws("/", F.col("tile_dir"), F.col("name")))
    return named.select(F.lit("mosaic_tiles").alias("source_table"), F.col("entry_id").alias("record_id"), F.lit("image_to_transform").alias("field_name"), key.alias("key"), F.col("recorded_at").alias("at"))


def image_lives(images: DataFrame) -> DataFrame:
    """(key, born, died) of each registered image. Rows without a path or a registration time, and empty lives, never live."""
    kept = images.filter("registered_at is not null and (deleted_at is null or deleted_at > registered_at)").filter(~is_blank(F.col("image_full_path")))
    return kept.select(resolved_path(F.col("image_full_path")).alias("key"), F.col("registered_at").alias("born"), F.col("deleted_at").alias("died"))


def orphan_references(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The references of ``refs`` (key, at, ...) whose key has no life in ``lives`` (key, born, died) that holds ``at``.

    Parent and child keys are united in long form and grouped by key and day: a group keeps the net number of lives that
    begin and end in it and whether children ask. The running sum of that number over a key's days says how many lives
    are open when a day begins, so a group lacks its parent if none is open and none begins in it. Only a group whose
    own day holds a birth or death carries those instants along, and only its children compare times.

    A key's window holds one row per day, not one per record, so a key with a third of all rows stays small; its
    children are never gathered, they only look up their group (AQE splits a skewed side of that join). Born counts from
    its instant, died from its own. A row delivered twice counts twice on both sides and changes nothing. A null ``at``
    lies in no life, so such a reference is an orphan.
    """
    day = lambda c: F.to_date(c)
    moves = F.array(F.struct(F.col("born").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("died").alias("ts"), F.lit(-1).alias("d")))
    events = lives.select("key", F.explode(moves).alias("e")).filter("e.ts is not null").select("key", day("e.ts").alias("day"), "e.ts", "e.d", F.lit(False).alias("child"))
    asked = refs.filter("at is not null").select("key", day("at").alias("day"), F.lit(None).cast(dict(events.dtypes)["ts"]).alias("ts"), F.lit(0).alias("d"), F.lit(True).alias("child"))
    tagged = events.unionByName(asked)
    groups = tagged.groupBy("key", "day").agg(
        F.sum("d").alias("net"),
        F.max("child").alias("child"),
        F.collect_list(F.when(F.col("d") != 0, F.struct("ts", "d"))).alias("moves"),
    )
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    state = groups.withColumn("open", F.coalesce(F.sum("net").over(before), F.lit(0))).filter("child").select("key", "day", "open", "moves")
    # A day without moves and with an open life answers for all its children: they need no row, absence means "lives".
    asks = state.filter("open <= 0 or size(moves) > 0")
    c, s = refs.withColumn("day", day("at")).alias("c"), asks.alias("s")
    alive = F.col("s.open") + F.aggregate(F.filter("s.moves", lambda m: m["ts"] <= F.col("c.at")), F.lit(0).cast("bigint"), lambda n, m: n + m["d"])
    timed = c.filter("day is not null").join(s, (F.col("c.key") == F.col("s.key")) & (F.col("c.day") == F.col("s.day"))).filter(alive <= 0).select("c.*").drop("day")
    return timed.unionByName(refs.filter("at is null"))


def all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    stos = load(spark, sf_dir, "stos_files").select("stos_id", "stos_dir", "recorded_at", *_STOS_FIELDS)
    mosaic = load(spark, sf_dir, "mosaic_tiles").select("entry_id", "tile_dir", "image_to_transform", "recorded_at")
    return stos_references(stos).unionByName(mosaic_references(mosaic))


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_lives(load(spark, sf_dir, "images").select("image_full_path", "registered_at", "deleted_at"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphan_references(all_references(spark, sf_dir), _lives(spark, sf_dir))
    return found.select("source_table", "record_id", "field_name").distinct()


def p1_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, field and month of recorded_at."""
    found = orphan_references(all_references(spark, sf_dir), _lives(spark, sf_dir))
    once = found.select("source_table", "record_id", "field_name", F.date_format("at", "yyyy-MM").alias("month")).distinct()
    return once.groupBy("source_table", "field_name", "month").agg(F.count("*").alias("n_orphans"))
