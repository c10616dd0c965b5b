"""Layouts as graphs: nodes (id, y, x) and edges (a, b, dy, dx, weight), an edge saying where b should lie from a."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import materialize

STEP = 0.95


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, with its offset negated."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), "weight")
    return edges.select("a", "b", "dy", "dx", "weight").unionByName(back)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of ``new`` put in the place of edges between the same nodes. A NaN or null weight is no edge."""
    pair = ["a", "b"]
    clean = new.filter("weight is not null and not isnan(weight)")
    return edges.join(clean.select(*pair), pair, "left_anti").select("a", "b", "dy", "dx", "weight").unionByName(clean.select("a", "b", "dy", "dx", "weight"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes ``gone`` (id) and the edges at them."""
    out = gone.select("id").distinct()
    left = edges.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti")
    return nodes.join(out, "id", "left_anti"), left.select("a", "b", "dy", "dx", "weight")


def weights_to_range(edges: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Weights stretched to lo .. hi; equal ones all become hi. The extrema, one row, are broadcast."""
    if lo >= hi:
        raise ValueError("lo must be below hi")
    ext = F.broadcast(edges.agg(F.min("weight").alias("wlo"), F.max("weight").alias("whi")))
    w = F.when(F.col("whi") == F.col("wlo"), hi).otherwise((F.col("weight") - F.col("wlo")) / (F.col("whi") - F.col("wlo")) * (hi - lo) + lo)
    return edges.crossJoin(ext).withColumn("weight", w).drop("wlo", "whi")


def weights_to_maximum(edges: DataFrame) -> DataFrame:
    """Weights relative to the largest; equal ones all become 1."""
    ext = F.broadcast(edges.agg(F.min("weight").alias("wlo"), F.max("weight").alias("whi")))
    return edges.crossJoin(ext).withColumn("weight", F.when(F.col("whi") == F.col("wlo"), 1.0).otherwise(F.col("weight") / F.col("whi"))).drop("wlo", "whi")


def tensions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node the sum of its edges' tensions, and their mean by weight (by plain sum of weighted tensions where all weights are 0)."""
    e = both_ways(edges)
    at = lambda k: nodes.select(F.col("id").alias(k), F.col("y").alias(f"{k}y"), F.col("x").alias(f"{k}x"))
    t = e.join(at("a"), "a").join(at("b"), "b").select("a", "weight", (F.col("by") - F.col("ay") - F.col("dy")).alias("ty"), (F.col("bx") - F.col("ax") - F.col("dx")).alias("tx"))
    w = F.sum("weight")
    share = lambda c: F.sum(F.col(c) * F.col("weight")) / F.when(w == 0, 1.0).otherwise(w)
    return t.groupBy(F.col("a").alias("id")).agg(F.sum("ty").alias("net_y"), F.sum("tx").alias("net_x"), share("ty").alias("weighted_y"), share("tx").alias("weighted_x"))


def relax_step(nodes: DataFrame, edges: DataFrame, step: float = STEP) -> DataFrame:
    """All nodes moved at once along their weighted tension."""
    t = tensions(nodes, edges)
    go = lambda c: (F.col(c) + step * F.coalesce(F.col(f"weighted_{c}"), F.lit(0.0))).alias(c)
    return nodes.join(t, "id", "left").select("id", go("y"), go("x"))


def relax(nodes: DataFrame, edges: DataFrame, cutoff: float = 0.1, most: int = 500, each: int = 3) -> DataFrame:
    """Steps until no node's weighted tension exceeds ``cutoff``, at most ``most``, where a warning says so; that is asked every ``each`` steps.

    A step reads the nodes three times, so they are written after every one: plans of several steps would grow as powers.
    """
    edges = materialize(edges)
    for k in range(most):
        nodes = materialize(relax_step(nodes, edges))
        if (k + 1) % each == 0 or k + 1 == most:
            worst = tensions(nodes, edges).agg(F.max(F.hypot("weighted_y", "weighted_x"))).first()[0]
            if worst is None or worst <= cutoff:
                return nodes
    warnings.warn(f"after {most} steps a tension is still above {cutoff}", stacklevel=2)
    return nodes


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected part, by labels that jump along edges and along labels.

    Each round a node takes the least label around it and then its label's own label, so the number of rounds grows with
    the logarithm of a part's width. Rounds are written to the shared folder; only a count of changes reaches the driver.
    """
    e = materialize(both_ways(edges).select("a", "b").distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        around = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = materialize(lower.join(jump, "component").select("id", "old", F.least("component", "root").alias("component")))
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def strongest_layout(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes placed along the heaviest edges, and those edges: (id, component, y, x) and the forest (a, b, weight).

    Every part of the layout takes its heaviest edge to another part and moves to where that edge puts it, all parts at
    once; so parts at least halve in number each round. Moves that follow each other are shifts, which add up along
    chains of parts by doubling. Equal weights are told apart by the nodes' ids, which makes the forest unique and free of
    cycles. A part's least node lies at (0, 0). Edges with a NaN or null weight don't count.
    """
    clean = edges.filter("weight is not null and not isnan(weight) and a <> b")
    flip = F.col("a") > F.col("b")
    sign = F.when(flip, -1.0).otherwise(1.0)
    one = clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("dy") * sign).alias("dy"), (F.col("dx") * sign).alias("dx"), "weight")
    live = materialize(one.groupBy("a", "b").agg(F.max(F.struct("weight", "dy", "dx")).alias("e")).select("a", "b", "e.dy", "e.dx", "e.weight"))
    state = nodes.select("id", F.col("id").alias("c"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))
    forest = live.select("a", "b", "weight").limit(0)
    while True:
        at = lambda k: state.select(F.col("id").alias(k), F.col("c").alias(f"c{k}"), F.col("y").alias(f"{k}y"), F.col("x").alias(f"{k}x"))  # noqa: E731, B023
        e = live.join(at("a"), "a").join(at("b"), "b").filter("ca <> cb")
        sy, sx = F.col("ay") + F.col("dy") - F.col("by"), F.col("ax") + F.col("dx") - F.col("bx")
        ends = F.explode(F.array(F.struct(F.col("cb").alias("c"), F.col("ca").alias("p"), sy.alias("sy"), sx.alias("sx")), F.struct(F.col("ca").alias("c"), F.col("cb").alias("p"), (-sy).alias("sy"), (-sx).alias("sx"))))
        rank = F.struct("weight", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        best = materialize(e.select(ends.alias("m"), "a", "b", "weight", rank.alias("r")).groupBy("m.c").agg(F.max_by(F.struct("m.p", "m.sy", "m.sx", "a", "b", "weight"), "r").alias("e")).select("c", "e.*"))
        if best.isEmpty():
            break
        forest = forest.unionByName(best.select("a", "b", "weight").distinct())
        # Two parts that chose each other did so by the same edge: the lower stays.
        back = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = best.join(back, "p", "left").filter("pp is null or pp <> c or c > p").select("c", "p", "sy", "sx")
        while True:
            up = materialize(up)
            nxt = up.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("sy").alias("ty"), F.col("sx").alias("tx"))
            if up.join(nxt, "p", "left_semi").isEmpty():
                break
            for _ in range(2):
                nxt = up.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("sy").alias("ty"), F.col("sx").alias("tx"))
                up = up.join(nxt, "p", "left").select("c", F.coalesce("q", "p").alias("p"), (F.col("sy") + F.coalesce("ty", F.lit(0.0))).alias("sy"), (F.col("sx") + F.coalesce("tx", F.lit(0.0))).alias("sx"))
        state = materialize(state.join(up, "c", "left").select("id", F.coalesce("p", "c").alias("c"), (F.col("y") + F.coalesce("sy", F.lit(0.0))).alias("y"), (F.col("x") + F.coalesce("sx", F.lit(0.0))).alias("x")))
    first = state.groupBy("c").agg(F.min(F.struct("id", "y", "x")).alias("f"))
    placed = state.join(first, "c").select("id", F.col("f.id").alias("component"), (F.col("y") - F.col("f.y")).alias("y"), (F.col("x") - F.col("f.x")).alias("x"))
    return placed, forest.distinct()


def merge_parts(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    """Parts (id, part, y, x) moved onto the part that most offsets join them to: by the mean of where the offsets put them.

    Offsets within a part don't count. Of the parts joined, the one of the lower number stays; a single round.
    """
    at = lambda k: placed.select(F.col("id").alias(k), F.col("part").alias(f"p{k}"), F.col("y").alias(f"{k}y"), F.col("x").alias(f"{k}x"))
    e = both_ways(offsets).join(at("a"), "a").join(at("b"), "b").filter("pa < pb")
    pair = e.groupBy("pa", "pb").agg(F.count("*").alias("n"), F.avg(F.col("ay") + F.col("dy") - F.col("by")).alias("sy"), F.avg(F.col("ax") + F.col("dx") - F.col("bx")).alias("sx"))
    move = pair.groupBy(F.col("pb").alias("part")).agg(F.max_by(F.struct("pa", "sy", "sx"), F.struct("n", (-F.col("pa")).alias("o"))).alias("m"))
    return placed.join(move, "part", "left").select("id", F.coalesce("m.pa", "part").alias("part"), (F.col("y") + F.coalesce("m.sy", F.lit(0.0))).alias("y"), (F.col("x") + F.coalesce("m.sx", F.lit(0.0))).alias("x"))


def merge_all_parts(placed: DataFrame, offsets: DataFrame) -> DataFrame:
    """``merge_parts`` until no offset joins two parts, so that chains of parts come together: parts get fewer each round."""
    offsets, placed = materialize(offsets), materialize(placed)
    while True:
        part = lambda k: placed.select(F.col("id").alias(k), F.col("part").alias(f"p{k}"))  # noqa: E731, B023
        if offsets.join(part("a"), "a").join(part("b"), "b").filter("pa <> pb").isEmpty():
            return placed
        placed = materialize(merge_parts(placed, offsets))
