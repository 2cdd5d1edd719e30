"""Hard negatives by a secondary-sort shuffle: for anchors, rows of another label that score just below the rows of their own label.

A row's score is its whole-number inner product with the anchor (components ``floor(256 * x)``).  Higher scores come first, ties by smaller id.
An anchor's positives are its first ``POSITIVES`` other rows of the same label.  For each positive, its negatives are the first ``NEGATIVES``
rows of another label with ``80 * positive_score <= 100 * negative_score <= 100 * positive_score``.

1. *Blocks.*  Rows are dealt to row blocks and anchors to anchor blocks by a hash of their id, and packed; each row block meets each anchor
   block once (anchors are the stated query set) and a matrix product gives the scores of that cell.
2. *Positives.*  A task keeps the first positives of an anchor over all its cells; a window takes the first ones of all tasks.
3. *Pair scores.*  With the positives known, a task keeps per window the first negatives over all its cells: no other pair can be among the first of all.
4. *Secondary sort.*  Scores become 24-byte keys (anchor, descending score, id) that sort as bytes.  ``repartitionAndSortWithinPartitions`` deals
   them by anchor; a streaming iterator reads them in order, opens a window at each positive, and gives each negative to the
   windows still open.  It holds the open windows and the first few negatives of the present score, never an anchor's rows.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Rows that share an id count once, as the one
with the smallest label and vector.  A shorter vector counts as filled up with zeros, an empty one scores 0.  Scores beyond +-9.2e16 count as that.
Anchors without another row of their label, and windows without a row, give nothing; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import big_join, release
from .common import batches_of, written
from .packed import returned

POSITIVES, NEGATIVES, LEAST, OF, SCALE = 5, 5, 80, 100, 256
#: Rows of a row block, anchors of an anchor block, anchors scored at a time, candidates held by a task before it hands them over.
ROWS, ANCHORS, STRIP, HELD = 8192, 4096, 128, 1 << 20
LARGEST = (2**63 - 1) // 100
_KEY = struct.Struct(">QQQ")
_PACK = "n long, dims long, ids binary, labels binary, vectors binary, windows binary"


def _whole(vectors: list[np.ndarray]) -> np.ndarray:
    """Components ``floor(256 * x)``, one row per vector, shorter ones filled up with zeros."""
    dims = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.clip(np.floor(SCALE * np.asarray(v, dtype=np.float64)), -(2.0**62), 2.0**62).astype(np.int64)
    return out


def _pack(got: pd.DataFrame) -> tuple:
    got = got.sort_values("id")
    vectors = _whole(list(got["vector"]))
    windows = np.full((len(got), POSITIVES), -1, dtype="<i8")  # scores of positives; a negative one has no window
    if "found" in got:
        for row, found in zip(windows, got["found"], strict=True):
            if found is not None:
                row[: len(found)] = found
    return (len(got), vectors.shape[1], got["id"].to_numpy("<i8").tobytes(), got["label"].to_numpy("<i8").tobytes(), vectors.astype("<i8").tobytes(), windows.tobytes())


def _packed(rows: DataFrame, block: str) -> DataFrame:
    def run(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *_pack(got))], columns=[block, *(c.split()[0] for c in _PACK.split(", "))])

    return rows.groupBy(block).applyInPandas(run, f"{block} int, {_PACK}")


def _numbers(r, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, dims = getattr(r, f"{side}_n"), getattr(r, f"{side}_dims")
    ids, labels, vectors, windows = (np.frombuffer(getattr(r, f"{side}_{c}"), "<i8") for c in ("ids", "labels", "vectors", "windows"))
    return ids, labels, vectors.reshape(n, dims), windows.reshape(n, POSITIVES)


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whole-number inner products, rows by anchors, exact (limited to what a long holds a hundred times)."""
    dims = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :dims], anchors[:, :dims]
    if not dims:
        return np.zeros((len(rows), len(anchors)), dtype=np.int64)
    bound = dims * max(1, int(rows.max()), -int(rows.min())) * max(1, int(anchors.max()), -int(anchors.min()))
    if bound < 2**53:
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if bound < LARGEST:
        return rows @ anchors.T
    exact = rows.astype(object) @ anchors.astype(object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n of each group, by descending score, then id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return order[place < n]


class _Kept:
    """First candidates per (anchor, window) over the cells of a task."""

    def __init__(self, n: int) -> None:
        self.n, self.held, self.lists = n, 0, {}

    def add(self, block: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        old = self.lists.pop(block, None)
        if old is not None:
            self.held -= len(old[0])
            group, score, ids = (np.concatenate(x) for x in zip(old, (group, score, ids), strict=True))
        best = _first(group, score, ids, self.n)
        self.lists[block] = (group[best], score[best], ids[best])
        self.held += len(best)

    def least(self, block: int, count: int) -> np.ndarray:
        """Score that a further candidate of each group has to reach."""
        out = np.full(count, np.iinfo(np.int64).min)
        if block in self.lists:
            group, score, _ = self.lists[block]
            full = np.bincount(group, minlength=count) >= self.n
            low = np.full(count, np.iinfo(np.int64).max)
            np.minimum.at(low, group, score)
            out[full] = low[full]
        return out


def _cells(blocks: DataFrame, anchors: DataFrame, count: int, parts: int) -> DataFrame:
    """One row per (row block, anchor block); dealt by row block, the single row block is the side that a join buffers."""
    named = lambda df, side: df.select(*(F.col(c).alias(c if c.endswith("_block") else f"{side}_{c}") for c in df.columns))
    copies = named(anchors, "a").withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).repartition(parts, "row_block")
    return copies.hint("merge").join(named(blocks, "r").repartition(parts, "row_block"), "row_block")


def _positives(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, names = _Kept(POSITIVES), {}

        def out() -> pd.DataFrame:
            parts = [(names[b][g], s, i) for b, (g, s, i) in kept.lists.items()]
            kept.lists, kept.held = {}, 0
            anchor, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
            return returned(pd.DataFrame({"anchor": anchor, "score": score, "id": ids}))

        for b in batches:
            for r in b.itertuples(index=False):
                ids, labels, rows, _ = _numbers(r, "r")
                names[r.anchor_block], own, vectors, _ = _numbers(r, "a")
                for at in range(0, len(own), STRIP):
                    some = slice(at, at + STRIP)
                    got = scores(rows, vectors[some])
                    least = kept.least(r.anchor_block, len(own))[some]
                    hit = (got >= least) & (labels[:, None] == own[None, some]) & (ids[:, None] != names[r.anchor_block][None, some])
                    row, col = np.nonzero(hit)
                    kept.add(r.anchor_block, col + at, got[row, col], ids[row])
                if kept.held > HELD:
                    yield out()
        yield out()

    found = cells.mapInPandas(run, "anchor long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", rank).where(F.col("place") <= POSITIVES).drop("place")


def key_of(anchor: int, score: int, row: int) -> bytes:
    """Key that sorts as (anchor, descending score, id)."""
    return _KEY.pack(anchor + 2**63, 2**63 - 1 - score, row + 2**63)


def _keys_of(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> bytes:
    flip = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.stack([flip(anchor), np.uint64(2**64 - 1) - flip(score), flip(ids)], axis=1).astype(">u8").tobytes()


def _negatives(cells: DataFrame) -> DataFrame:
    """Packed keys of the pairs that can be negatives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, names = _Kept(NEGATIVES), {}

        def out() -> pd.DataFrame:
            keys = []
            for b, (group, score, ids) in kept.lists.items():
                one = np.unique(np.stack([names[b][group // POSITIVES], score, ids], axis=1), axis=0)  # a row may be in several windows
                keys += [_keys_of(*x.T) for x in np.array_split(one, max(1, len(one) // 4096)) if len(x)]
            kept.lists, kept.held = {}, 0
            return returned(pd.DataFrame({"keys": keys}))

        for b in batches:
            for r in b.itertuples(index=False):
                ids, labels, rows, _ = _numbers(r, "r")
                names[r.anchor_block], own, vectors, windows = _numbers(r, "a")
                for at in range(0, len(own), STRIP):
                    some = slice(at, at + STRIP)
                    got = scores(rows, vectors[some])
                    top = windows[some].max(axis=1)
                    low = np.where(windows[some] >= 0, windows[some], np.iinfo(np.int64).max).min(axis=1)
                    # every window of an anchor lies between 80 % of its lowest positive and its highest one
                    hit = (got <= top) & (got >= low - low // 5 - 1) & (labels[:, None] != own[None, some]) & (top >= 0)
                    row, col = np.nonzero(hit)
                    group, score, found = [], [], []
                    for k in range(POSITIVES):
                        edge, s = windows[some][col, k], got[row, col]
                        fits = (s <= edge) & (LEAST * edge <= OF * s) & (edge >= 0)
                        group.append((col[fits] + at) * POSITIVES + k)
                        score.append(s[fits])
                        found.append(ids[row[fits]])
                    kept.add(r.anchor_block, *(np.concatenate(x) for x in (group, score, found)))
                if kept.held > HELD:
                    yield out()
        yield out()

    return cells.mapInPandas(run, "keys binary")


def windows_of(records: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """From sorted (key, same label) records: anchor, positive, rank, negative and the two scores.

    The first ``POSITIVES`` records of the anchor's label open a window each; a window ends when it is full or the score is too low."""
    anchor = level = None
    for key, same in records:
        a, score, row = _KEY.unpack(key)
        score = 2**63 - 1 - score
        if a != anchor:
            anchor, level, seen, opened, ties = a, None, 0, [], []
        if score != level:
            level, ties = score, []
            opened = [w for w in opened if w[2] < NEGATIVES and LEAST * w[1] <= OF * score]
        if same:
            if seen < POSITIVES and score >= 0:  # below zero no score is between 80 % and all of it
                opened.append(window := [row - 2**63, score, 0])
                for negative in ties:  # of the same score, smaller id
                    window[2] += 1
                    yield a - 2**63, window[0], window[2], negative, score, score
            seen += 1
            continue
        if len(ties) < NEGATIVES:
            ties.append(row - 2**63)
        for window in opened:
            if window[2] < NEGATIVES:
                window[2] += 1
                yield a - 2**63, window[0], window[2], row - 2**63, window[1], score


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` is a condition on the column ``id`` (a long)."""
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    rows = written(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"), "negatives-rows")
    count = -(-max(rows.count(), 1) // ROWS)
    chosen = rows.where(is_anchor)
    dealt = chosen.withColumn("anchor_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(-(-max(chosen.count(), 1) // ANCHORS))).cast("int"))
    blocks = written(_packed(rows.withColumn("row_block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")), "row_block"), "negatives-blocks")
    with batches_of(spark, 2):
        positives = written(_positives(_cells(blocks, _packed(dealt, "anchor_block"), count, parts)), "negatives-positives")
        found = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("found"))
        known = big_join(dealt, found, "id")  # anchors without a positive have no window
        keys = written(_negatives(_cells(blocks, _packed(known, "anchor_block"), count, parts)), "negatives-keys")
    release(blocks, rows)
    size = _KEY.size
    pairs = keys.rdd.flatMap(lambda r: ((bytes(r[0][at : at + size]), False) for at in range(0, len(r[0]), size)))
    pairs = pairs.union(positives.rdd.map(lambda r: (key_of(r[0], r[1], r[2]), True)))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(
        ordered.mapPartitions(windows_of), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
