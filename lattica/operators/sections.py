"""Sections of a volume: adjacency by rank, nearest sections, and the tree along which they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.tables import materialize


def ranked(sections: DataFrame) -> DataFrame:
    """Distinct sections with their rank. Section numbers count in thousands, so one window holds them."""
    return sections.select("section").filter("section is not null").distinct().withColumn("rank", F.row_number().over(Window.orderBy("section")) - 1)


def section_pairs(sections: DataFrame, threshold: int = 2, centre: int | None = None) -> DataFrame:
    """(mapped, control) pairs: each section with those at most ``threshold`` ranks nearer to the centre, from either side.

    The centre is the middle section, or the one nearest to ``centre``.
    """
    r = ranked(sections)
    if centre is None:
        mid = r.agg(F.floor(F.max("rank") / 2).alias("mid"))
    else:
        mid = r.agg(F.min_by("rank", F.struct(F.abs(F.col("section") - centre), "section")).alias("mid"))
    m = r.crossJoin(F.broadcast(mid)).select(F.col("section").alias("mapped"), "rank", "mid")
    step = F.explode(F.sequence(F.lit(1), F.lit(threshold))).alias("step")
    near = m.filter("rank <> mid").select("mapped", "rank", "mid", step).withColumn("to", F.when(F.col("rank") < F.col("mid"), F.col("rank") + F.col("step")).otherwise(F.col("rank") - F.col("step")))
    inside = near.filter(((F.col("rank") < F.col("mid")) & (F.col("to") <= F.col("mid"))) | ((F.col("rank") > F.col("mid")) & (F.col("to") >= F.col("mid"))))
    return inside.join(r.select(F.col("section").alias("control"), F.col("rank").alias("to")), "to").select("mapped", "control")


def nearest_section(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """(asked, section): the nearest section to each number, the lower of two. A lookup on both sides by window, not a cross join."""
    both = asked.select(F.col("asked").alias("n"), F.lit(1).alias("q")).distinct().unionByName(sections.select(F.col("section").alias("n"), F.lit(0).alias("q")).distinct())
    own = F.when(F.col("q") == 0, F.col("n"))
    w = Window.orderBy("n", "q")
    below = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.select("n", "q", below.alias("lo"), above.alias("hi")).filter("q = 1")
    pick = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(F.col("n") - F.col("lo") <= F.col("hi") - F.col("n"), F.col("lo")).otherwise(F.col("hi"))
    return found.select(F.col("n").alias("asked"), pick.alias("section"))


def tree_depth(pairs: DataFrame) -> DataFrame:
    """(section, depth): the fewest registrations between each section and a root, which is a control that is mapped to nothing."""
    roots = pairs.select(F.col("control").alias("section")).distinct().join(pairs.select(F.col("mapped").alias("section")), "section", "left_anti")
    done = materialize(roots.select("section", F.lit(0).alias("depth")))
    front, depth = done, 0
    while True:
        depth += 1
        step = front.select(F.col("section").alias("control")).join(pairs, "control").select(F.col("mapped").alias("section")).distinct()
        front = materialize(step.join(done, "section", "left_anti").select("section", F.lit(depth).alias("depth")))
        if front.isEmpty():
            return done
        done = materialize(done.unionByName(front))
