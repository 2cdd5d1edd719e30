"""List ranking: the place of every element of many linked lists, of any length, by pointer doubling.

Each row points to its successor (or to none).  Every round follows all pointers twice as far, so lists and rings of length n take about log2(n)
rounds of one join; no task sees a whole list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sheetseam.session import big_join, materialize, release


#: ``rest`` of the first element of a ring.
FIRST = 1 << 62


def rank_lists(links: DataFrame) -> DataFrame:
    """``id, label, rest, ring`` from ``id, next`` (both long; every ``next`` is the ``id`` of one row and of no other row's ``next``).

    An open list is labelled by its last element, a ring by its smallest, where it begins; ``rest`` falls along a list (in an open one: the number of
    elements from this one to the last).

    A row knows ``count`` elements from itself on: the smallest of them (``low``, ``to`` steps away) and the last.  A round in which no ``low`` of
    a ring falls has seen all of it, as along a ring of windows ``low`` cannot only grow."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    state = links.select("id", F.col("next").alias("ptr"), one.alias("count"), F.col("id").alias("low"), zero.alias("to"), F.col("id").alias("last"))
    state = materialize(state, "ranks")
    while True:
        ahead = state.select(F.col("id").alias("ptr"), *(F.col(c).alias(f"n_{c}") for c in ("count", "low", "to", "last")), F.col("ptr").alias("n_ptr"))
        lower = F.coalesce(F.col("n_low") < F.col("low"), F.lit(False))
        further = big_join(state, ahead, "ptr", "left").select(
            "id",
            F.col("n_ptr").alias("ptr"),
            (F.col("count") + F.coalesce("n_count", zero)).alias("count"),
            F.when(lower, F.col("n_low")).otherwise(F.col("low")).alias("low"),
            F.when(lower, F.col("count") + F.col("n_to")).otherwise(F.col("to")).alias("to"),
            F.coalesce("n_last", "last").alias("last"),
            # an open list that came to its end, or a smaller element, asks for another round
            (F.col("n_last").isNotNull() & (lower | F.col("n_ptr").isNull())).alias("moved"),
        )
        seen = Observation()
        further = materialize(further.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("n")).drop("moved"), "ranks")
        release(state)
        state = further
        if not seen.get["n"]:
            break
    ring = F.col("ptr").isNotNull()
    rest = F.when(~ring, F.col("count")).when(F.col("to") == 0, F.lit(FIRST)).otherwise(F.col("to"))
    return state.select("id", F.when(ring, F.col("low")).otherwise(F.col("last")).alias("label"), rest.alias("rest"), ring.alias("ring"))
