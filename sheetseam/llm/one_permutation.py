"""Document fingerprints: one-permutation MinHash, densified, packed to four bits a bin.  SQL functions only.

Each five-word shingle is hashed once.  The top seven bits of the hash choose one of ``BINS`` bins and the smallest
hash of a bin is its value.  An empty bin takes the value of a filled bin: of all filled bins the
one whose keyed hash with the empty bin's number is smallest, which is what optimal densification draws (uniform among
the filled bins, and the same bin for any text whose filled bins hold that one), without a bound on attempts.
A copied value is hashed with the number of its new bin, so that a chance agreement of two values is not copied along.
The low four bits of each value are packed, sixteen bins to a long.

Likeness is the share of equal bins, corrected for the one in sixteen that agree by chance:
``max(0, (share - 1/16) / (1 - 1/16))``; equal fingerprints give exactly 1.

Words are split at ASCII white space after lower-casing A-Z.  A text of one to four words is one shingle; null, empty and
blank texts have an empty fingerprint, like only to another empty one (1, otherwise 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, LANE_BITS, WORDS = 128, 4, 5
_PER_LONG = 64 // LANE_BITS
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower()), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(ws: Column) -> Column:
    """One 64-bit hash per shingle (repeats included) of a bound array of words."""
    n = F.size(ws)
    each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(WORDS))))
    return F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS.bit_length() - 1)).cast("int")


def _bin_minima(hashes: Column) -> Column:
    """The smallest hash of each filled bin: the first of its bin in sorted order."""
    return bound(
        F.sort_array(hashes),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))),
    )


def _lane(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << LANE_BITS) - 1)).cast("int")


def _dense(minima: Column) -> Column:
    """The lanes of all bins, in the order of bins."""
    entry = lambda b, v: F.struct(b.alias("b"), v.alias("v"))
    filled = F.transform(minima, lambda x: entry(_bin(x), _lane(x)))

    def fill(missing: Column) -> Column:
        return F.transform(
            missing,
            lambda b: entry(b, _lane(F.xxhash64(F.array_min(F.transform(minima, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("h"), x.alias("x"))))["x"], b))),
        )

    missing = F.array_except(F.array([F.lit(b) for b in range(BINS)]), F.transform(minima, _bin))
    every = F.when(F.size(minima) == BINS, filled).otherwise(F.concat(filled, bound(missing, fill)))
    return F.sort_array(every)["v"]


def _pack(lanes: Column) -> Column:
    longs = [
        F.aggregate(F.slice(lanes, 1 + k * _PER_LONG, _PER_LONG), F.lit(0).cast("bigint"), lambda a, v: F.shiftleft(a, LANE_BITS).bitwiseOR(v.cast("bigint")))
        for k in range(BINS // _PER_LONG)
    ]
    return F.array(*longs)


def fingerprint(text: Column) -> Column:
    """array<bigint>: the packed fingerprint, empty for a text without words."""
    minima = bound(words(text), lambda ws: _bin_minima(shingle_hashes(ws)))
    return bound(
        minima,
        lambda m: F.when(F.size(m) == 0, F.array().cast("array<bigint>")).otherwise(bound(_dense(m), _pack)),
    )


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda p: F.lower(F.lpad(F.hex(p), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints."""
    low = int("1" * _PER_LONG, 16)

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(low)))

    differing = sum((unequal(k) for k in range(1, BINS // _PER_LONG)), unequal(0))
    chance = 1 / (1 << LANE_BITS)
    share = (F.lit(BINS) - differing) / F.lit(float(BINS))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return (
        F.when(empty_a & empty_b, 1.0)
        .when(empty_a | empty_b, 0.0)
        .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))
    )


def fingerprints(docs: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """``docs`` plus the packed fingerprint of a text column."""
    return docs.withColumn(name, fingerprint(F.col(f"`{text}`")))


def _bucket(key: Column, bounds: list, lo: int = 0) -> Column:
    """Number of bounds up to and including the key, by a binary tree of comparisons."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(key < F.lit(bounds[mid]), _bucket(key, bounds[:mid], lo)).otherwise(_bucket(key, bounds[mid + 1 :], lo + mid + 1))


def with_next(docs: DataFrame, key: str, text: str, carried: list[str]) -> DataFrame:
    """``docs`` plus ``next_<c>`` of the next row for each carried column; the last row's next is the first.

    Rows are ordered by the key, then the text (equal rows are alike, so their order is of no account; null keys
    come first).  The order is cut into key ranges at approximate quantiles, one window each; what follows a
    range is the first row of the next one, a table of one row per range."""
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], F.lit(20 * n))).first()[0] or []
    ranged = docs.withColumn("__range", F.when(F.col(key).isNull(), -1).otherwise(_bucket(F.col(key), sorted(set(cuts)))))
    order = [F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()]
    w = Window.partitionBy("__range").orderBy(*order)
    here = F.struct(*(F.col(c).alias(f"next_{c}") for c in carried))
    led = ranged.withColumn("__next", F.lead(here).over(w))
    # first row of each range: the smallest key (a cheap aggregate), then the smallest text among equal keys
    least = ranged.groupBy("__range").agg(F.min(key).alias("__least"))
    firsts = ranged.join(
        F.broadcast(least.select(F.col("__range").alias("__r"), "__least")), (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__least"))
    )  # one row per range: as many as there are partitions
    firsts = firsts.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(F.col(text).asc_nulls_first()))).where("__k = 1")
    firsts = firsts.select(F.col("__range").alias("__first_range"), here.alias("__first"))
    all_ranges = Window.orderBy("__first_range")  # over one row per range
    whole = Window.orderBy("__first_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select(
        F.col("__first_range").alias("__of"), F.coalesce(F.lead("__first").over(all_ranges), F.first("__first").over(whole)).alias("__after"),
    )
    out = led.join(follows.hint("merge"), F.col("__range") == F.col("__of"))
    return out.select(*docs.columns, F.coalesce("__next", "__after").alias("__next")).select(*docs.columns, "__next.*")


def edit_report(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row its fingerprint and that of its edited text (the last half replaced by the beginning of the
    next row's), with the likeness to the edited text and to the next row's text."""
    whole = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marked = with_next(whole.withColumn("print", fingerprint(F.col("text"))), "doc_id", "text", ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    edited = marked.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", changed.alias("edited"))
    both = edited.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
