"""Connected groups of the join list, and the array-set operators around them.

The reference closes the pair list with a recursive CTE that unions id
arrays until nothing changes.  Here every node hooks to its smallest neighbour,
pointers double up to the roots, and the edges between different roots make the next,
smaller graph.  Every step is cut from its lineage by writing it to the shared folder
named by ``spark.checkpoint.dir``.  Groups stay in long form ``(id, comp)``;
``comp`` is the smallest id of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheetseam.functions.arrays import ids_text
from sheetseam.session import big_join, materialize, release

#: Keys that the label of a large group is split over when labels are looked up.
SALTS = 16


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst")


def _jumped(forest: DataFrame) -> DataFrame:
    """``forest`` (id, comp) with every pointer followed once more; ``moved`` marks what changed.

    Only pointers at nodes that point on are looked up, and the pointer shared by a large group is
    split over SALTS keys."""
    inner = forest.filter("comp != id").select(
        F.col("id").alias("lid"), F.col("comp").alias("lcomp"), F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("lsalt")
    )
    salted = forest.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    both = big_join(salted, inner, (F.col("comp") == F.col("lid")) & (F.col("salt") == F.col("lsalt")), "left")
    return both.select("id", F.coalesce("lcomp", "comp").alias("comp"), F.col("lcomp").isNotNull().alias("moved"))


def _roots(e: DataFrame) -> DataFrame:
    """Every node hooks to its smallest neighbour (if smaller than itself); pointers then double up to the roots."""
    forest = materialize(
        e.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("comp")), "cc-labels"
    )
    while True:
        seen = Observation()
        deeper = _jumped(forest).observe(seen, F.count(F.when(F.col("moved"), 1)).alias("n")).select("id", "comp")
        deeper = materialize(deeper, "cc-labels")
        release(forest)
        forest = deeper
        if not seen.get["n"]:
            return forest


def connected_components(edges: DataFrame, a: str = "merge_id", b: str = "drop_id") -> DataFrame:
    """``(id, comp)`` for every id in ``edges``; ``comp`` = min id of its connected group.

    Every level hooks and contracts: each unfinished group at least halves, and pointers double, so the number of
    jobs is logarithmic in the largest group whatever its shape.  Levels end when no edge is left."""
    e = materialize(_undirected(edges, a, b), "cc-edges")
    levels = []
    while True:
        roots = _roots(e)
        levels.append(roots)
        seen = Observation()
        src = big_join(e, roots.select(F.col("id").alias("src"), F.col("comp").alias("s")), "src")
        both = big_join(src, roots.select(F.col("id").alias("dst"), F.col("comp").alias("d")), "dst")
        left = both.filter("s != d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
        smaller = materialize(left.observe(seen, F.count(F.lit(1)).alias("n")), "cc-edges")
        release(e)
        e = smaller
        if not seen.get["n"]:
            break
    release(e)
    labels = levels[-1]
    for lower in reversed(levels[:-1]):
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        labels = big_join(lower, up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    return labels


def group_lists(membership: DataFrame, id_col: str = "id", comp_col: str = "comp") -> DataFrame:
    """``(comp, flist, n)``: the sorted member list of each group (output form only)."""
    return membership.groupBy(comp_col).agg(
        F.sort_array(F.collect_list(id_col)).alias("flist"), F.count(F.lit(1)).alias("n")
    )


def group_lists_text(membership: DataFrame) -> DataFrame:
    g = group_lists(membership)
    return g.select("comp", ids_text("flist").alias("flist"), "n")


def maximal_sets(arrays: DataFrame, col: str = "ids") -> DataFrame:
    """Keep arrays that are not contained in a longer array (and each distinct array once).

    An array is dropped when one of its elements belongs to a longer array:
    explode, ``max(size)`` per element, anti-join; equal arrays collapse by ``distinct``.
    """
    a = arrays.select(F.sort_array(F.array_distinct(F.col(col))).alias("ids")).distinct()
    a = a.withColumn("len", F.size("ids"))
    per_elem = a.select(F.explode("ids").alias("e"), "len").groupBy("e").agg(F.max("len").alias("mx"))
    dominated = (
        a.select("ids", "len", F.explode("ids").alias("e"))
        .join(per_elem, "e")
        .filter(F.col("mx") > F.col("len"))
        .select("ids")
        .distinct()
    )
    return a.join(dominated, "ids", "left_anti").select("ids")
