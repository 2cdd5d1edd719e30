"""Line merge as joins: paths are sewn where exactly two path ends meet, chains are ordered by list ranking.

Every path travels twice, once in each direction (numbers ``2 * path`` and ``2 * path + 1``), so a chain is two lists that mirror each other; one of them
is kept: the one that starts at the smaller of the two free ends, of a ring the one that runs its smallest path forwards.  A group
with a junction gives its real pieces.  Neither a group nor a chain has to fit into a task until its vertices become one geometry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheetseam.functions import geometry as G
from sheetseam.operators.ranking import rank_lists
from sheetseam.session import big_join, materialize


def paths_of(members: DataFrame, group: str = "comp", geom: str = "geom") -> DataFrame:
    """``comp, pid, pts, a, b``: the (snapped) paths of all members with their end points, numbered.  Written, which fixes the numbers."""
    paths = members.select(F.col(group).alias("comp"), F.explode(F.flatten(G.snap(geom)["parts"])).alias("pts")).where(F.size("pts") > 1)
    ends = paths.select("comp", F.monotonically_increasing_id().alias("pid"), "pts", F.element_at("pts", 1).alias("a"), F.element_at("pts", -1).alias("b"))
    return materialize(ends, "paths")


def _ends(paths: DataFrame) -> DataFrame:
    side = lambda c, k: F.struct(F.col(c).alias("pt"), F.lit(k).cast("long").alias("side"))
    return paths.select("comp", "pid", F.explode(F.array(side("a", 0), side("b", 1))).alias("e")).select("comp", "pid", "e.pt", "e.side")


def chains(paths: DataFrame) -> DataFrame:
    """``comp, pid, chain, rest, turned, ring``: the chain of every path, its place (``rest`` falls along the chain), and whether the chain runs it
    backwards.  ``chain`` is a number within all groups."""
    ends = _ends(paths)
    end = F.struct("pid", "side")
    met = ends.groupBy("comp", "pt").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("p"), F.max(end).alias("q")).where("n = 2")
    leave = lambda e: 2 * F.col(f"{e}.pid") + 1 - F.col(f"{e}.side")
    enter = lambda e: 2 * F.col(f"{e}.pid") + F.col(f"{e}.side")
    step = lambda a, b: F.struct(leave(a).alias("id"), enter(b).alias("next"))
    steps = met.select(F.explode(F.array(step("p", "q"), step("q", "p"))).alias("s")).select("s.id", "s.next")
    both = paths.select(F.explode(F.array(2 * F.col("pid"), 2 * F.col("pid") + 1)).alias("id"))
    ranked = materialize(rank_lists(big_join(both, steps, "id", "left")).withColumn("pid", F.floor(F.col("id") / 2)), "ranked")
    placed = big_join(ranked, paths.select("pid", "comp", "a", "b"), "pid").withColumn("turned", F.col("id") % 2 == 1)
    start = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a"))
    stop = F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    mirror = F.col("id") + 1 - 2 * (F.col("id") % 2)
    # an open list against its mirror image, which starts where this one stops
    heads = placed.where("NOT ring").groupBy("label").agg(
        F.max_by(F.struct(start.alias("pt"), "id"), "rest").alias("first"), F.min_by(F.struct(stop.alias("pt"), mirror.alias("id")), "rest").alias("other")
    )
    kept = heads.where("first <= other").select("label", F.lit(False).alias("ring")).unionByName(
        placed.where("ring AND label % 2 = 0").select("label", F.lit(True).alias("ring")).distinct()
    )
    return big_join(placed, kept, ["label", "ring"]).select("comp", "pid", F.col("label").alias("chain"), "rest", "turned", "ring")


def sewn(paths: DataFrame) -> DataFrame:
    """``comp, chain, pts, n_paths``: the vertices of every chain, in order."""
    placed = big_join(chains(paths).drop("comp"), paths.select("comp", "pid", "pts"), "pid")
    run = F.struct((-F.col("rest")).alias("at"), F.when(F.col("turned"), F.reverse("pts")).otherwise(F.col("pts")).alias("pts"))
    lists = placed.groupBy("comp", "chain").agg(F.sort_array(F.collect_list(run)).alias("runs"), F.count(F.lit(1)).alias("n_paths"))
    rest = F.flatten(F.transform(F.slice(F.col("runs.pts"), 2, F.greatest(F.size("runs") - 1, F.lit(1))), lambda p: F.slice(p, 2, F.size(p))))
    return lists.select("comp", "chain", F.concat(F.element_at("runs.pts", 1), rest).alias("pts"), "n_paths")


def as_lines(chained: DataFrame) -> DataFrame:
    """``comp, geom``: one LINESTRING, or a MULTILINESTRING with the pieces in the order of their vertices."""
    parts = chained.groupBy("comp").agg(F.transform(F.sort_array(F.collect_list("pts")), lambda p: F.array(p)).alias("parts"))
    gtype = F.when(F.size("parts") == 1, F.lit("LINESTRING")).otherwise(F.lit("MULTILINESTRING"))
    return parts.select("comp", F.struct(gtype.alias("gtype"), "parts").alias("geom"))


def merge_lines(members: DataFrame) -> DataFrame:
    """``comp, geom``: line merge of each group."""
    return as_lines(sewn(paths_of(members)))


def without_loops(members: DataFrame) -> DataFrame:
    """``comp, geom``: line merge of each group without its loops.

    A loop is a chain that ends where it starts, of one path or of several, on its own or hanging at a junction.  When loops are gone, chains that
    ended at them go on and may be loops in turn; rounds end when none is left.  A group that is nothing but loops stays as it is."""
    paths, done = paths_of(members), []
    while True:
        chained = materialize(sewn(paths), "chains")
        closed = F.element_at("pts", 1) == F.element_at("pts", -1)
        counts = chained.groupBy("comp").agg(F.count(F.when(closed, 1)).alias("loops"), F.count(F.lit(1)).alias("n"))
        seen = Observation()
        mended = counts.where("loops > 0 AND loops < n").select("comp").observe(seen, F.count("comp").alias("n"))
        mended = materialize(mended, "mended")
        if not seen.get["n"]:
            return as_lines(reduce(DataFrame.unionByName, [*done, chained]))
        # groups that lost no loop are as they will be: only the others go on
        done.append(big_join(chained, mended, "comp", "left_anti"))
        held = big_join(chained, mended, "comp").where(~closed)
        paths = materialize(
            held.select("comp", F.monotonically_increasing_id().alias("pid"), "pts", F.element_at("pts", 1).alias("a"), F.element_at("pts", -1).alias("b")), "paths"
        )


def without_triple_points(members: DataFrame) -> DataFrame:
    """``comp, geom``: line merge of each group after the first of three vertices at one point is dropped (first by path, then along it), so that the
    paths of the other two are sewn there.  Paths left with one vertex vanish."""
    paths = paths_of(members)
    each = paths.select("comp", "pid", F.posexplode("pts").alias("at", "pt"))
    first = each.groupBy("comp", "pt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pid", "at")).alias("first")).where("n = 3")
    gone = first.groupBy(F.col("first.pid").alias("pid")).agg(F.collect_set("first.at").alias("gone"))
    both = big_join(paths.select("comp", "pid", "pts"), gone, "pid", "left")
    left = F.expr("filter(pts, (p, i) -> NOT array_contains(gone, i))")
    kept = both.withColumn("pts", F.when(F.col("gone").isNull(), F.col("pts")).otherwise(left)).where(F.size("pts") > 1)
    again = kept.select("comp", "pid", "pts", F.element_at("pts", 1).alias("a"), F.element_at("pts", -1).alias("b"))
    return as_lines(sewn(materialize(again, "paths")))
