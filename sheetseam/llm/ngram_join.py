"""N-gram Jaccard join: near duplicates by a prefix-tree join over globally ordered shingle sets.

Two rows link when ``100 * |x & y| >= 75 * |x | y|`` over their distinct five-word shingles (64-bit hashes of words
lower-cased A-Z and split at ASCII white space; a text of one to four words is one shingle).  The result is one row per
input row with its set size and the smallest document id that its links reach.

1. *Shared shingles.*  Shingles travel to hash shards, where those of a single row drop out; the others return to their row.
   A row needs partners for three quarters of its set, so most rows end here with no partner.
2. *Copies.*  Rows with the same set become one representative, linked to each copy.
3. Step 1 again among representatives, which also counts in how many of them a shingle is: the global order (rarest first).
4. *Prefix-tree join.*  Representatives that agree in a min-hash (two of them) are stored in a prefix tree, shared shingles first, so
   that sets with the same beginning share the work of counting their overlap with a probe.  A subtree is
   left when its remaining length cannot reach the overlap that its sizes ask for, or when all of it is already in the probe's
   component.  Large groups are cut into blocks by a hash of the row.
5. *The rest, exactly.*  Two sets that link share a shingle among the first ``n - ceil(0.75 n) + 1`` of either.  Representatives of different
   components that share such a shingle and pass the length and position bounds are compared; nothing is capped.

Rows without words have no shingle and no link.  Null ids: the row is kept with a null component and links nothing.  Rows with
the same id are one node.  Repeated rows are kept.  The input is read once; its rows must come in the same order if a
task is repeated (a table read does).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import big_join
from .common import shards, written
from .packed import by_shard, mixed, pack_sorted, returned, unpack_sorted, word_hashes

WORDS, NEAR, OF = 5, 75, 100
#: Representatives that one prefix tree holds.
BLOCK = 500
#: Tasks that a group of copies is spread over.
SALTS = 16
_FACTORS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_MAIL = "shard int, batch long, meta binary, keys binary, of binary"
_BACK = "batch long, meta binary, keys binary, of binary, df binary"


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, begin = word_hashes([t or "" for t in texts])
    n = max(0, len(h) - WORDS + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        rolled += h[k : k + n] * _FACTORS[k]
    rolled = mixed(rolled)
    out = []
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        if j - i >= WORDS:
            out.append(np.unique(rolled[i : j - WORDS + 1]))
        elif j > i:
            few = np.uint64(j - i)
            for x in h[i:j]:
                few = mixed(np.array([few ^ x], dtype=np.uint64))[0]
            out.append(np.array([few], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def needed(n: int) -> int:
    """Least overlap of a set of n shingles with any set that it links to."""
    return -(-NEAR * n // OF)


def _post(batch: int, ids: np.ndarray, rows: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], parts: int) -> pd.DataFrame:
    """Letters to the shards with the sets of a batch, and one with the batch's own data."""
    keys = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    of = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    cut = np.searchsorted(by_shard(keys, parts), np.arange(parts + 1))
    meta = np.stack([ids, rows, sizes]).astype("<i8").tobytes()
    out = [(batch % parts, batch, meta, None, None)]
    out += [(s, batch, None, pack_sorted(keys[i:j]), of[i:j].tobytes()) for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
    return returned(pd.DataFrame(out, columns=["shard", "batch", "meta", "keys", "of"]))


def _number() -> Iterator[int]:
    """Numbers of the batches of a task, each with room for 2**16 rows."""
    at = TaskContext.get().partitionId() << 40
    while True:
        yield at
        at += 1 << 16


_ROW = "doc_id long, row long, n long, keys binary, grip array<long>, prefix array<long>"


def _shared(mail: DataFrame, parts: int, ordered: bool = False) -> DataFrame:
    """Of every set only the shingles that other sets have too; one row per sent row, ``keys`` null if there
    are too few of them for any link.  If ``ordered``, also two min-hashes (``grip``) and the shared shingles of
    the prefix in the global order, rarest first, then by hash."""

    def at_shard(got: pd.DataFrame) -> pd.DataFrame:
        out = [(b, m, None, None, None) for b, m in zip(got["batch"], got.meta, strict=True) if m is not None]
        letters = got[got["keys"].notna()]
        lists = [unpack_sorted(k) for k in letters["keys"]]
        if lists:
            keys = np.concatenate(lists)
            _, where, n = np.unique(keys, return_inverse=True, return_counts=True)
            df, at = n[where].astype("<u4"), 0
            for b, of, one in zip(letters["batch"], letters["of"], lists, strict=True):
                d = df[at : at + len(one)]
                at += len(one)
                keep = d > 1
                if keep.any():
                    out.append((b, None, pack_sorted(one[keep]), np.frombuffer(of, "<u2")[keep].tobytes(), d[keep].tobytes()))
        return returned(pd.DataFrame(out, columns=["batch", "meta", "keys", "of", "df"]))

    def at_home(got: pd.DataFrame) -> pd.DataFrame:
        ids, rows, sizes = np.frombuffer(next(m for m in got.meta if m is not None), "<i8").reshape(3, -1)
        letters = got[got["keys"].notna()]
        keys = np.concatenate([unpack_sorted(k) for k in letters["keys"]] or [np.zeros(0, np.uint64)])
        of = np.concatenate([np.frombuffer(x, "<u2") for x in letters["of"]] or [np.zeros(0, np.uint16)])
        df = np.concatenate([np.frombuffer(x, "<u4") for x in letters["df"]] or [np.zeros(0, np.uint32)])
        order = np.lexsort((keys, of))
        keys, of, df = keys[order], of[order], df[order]
        cut = np.searchsorted(of, np.arange(len(ids) + 1))
        out = []
        for k, n in enumerate(sizes.tolist()):
            i, j = cut[k], cut[k + 1]
            if n == 0 or j - i < needed(n):
                out.append((ids[k], rows[k], n, None, None, None))
                continue
            own, grip, prefix = keys[i:j], None, None
            if ordered:
                grip = [int(mixed(own ^ np.uint64(s)).min().astype(np.int64)) for s in (1, 2)]
                first = n - needed(n) + 1 - (n - len(own))  # those of this row alone come before the shared ones
                prefix = own[np.lexsort((own, df[i:j]))][: max(first, 0)].astype(np.int64)
            out.append((ids[k], rows[k], n, own.tobytes(), grip, prefix))
        return returned(pd.DataFrame(out, columns=["doc_id", "row", "n", "keys", "grip", "prefix"]))

    back = mail.groupBy("shard").applyInPandas(at_shard, _BACK)
    return back.groupBy("batch").applyInPandas(at_home, _ROW)


def _from_texts(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, b in zip(_number(), batches, strict=False):
            sets = shingle_sets(b["text"].tolist())
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            ids = b["doc_id"].to_numpy(np.int64)
            known = b["known"].to_numpy(bool)
            yield _post(number, ids, np.where(known, number + np.arange(len(b)), -1), sizes, [s if k else s[:0] for s, k in zip(sets, known, strict=True)], parts)

    return docs.mapInPandas(run, _MAIL)


def _from_sets(sets: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, b in zip(_number(), batches, strict=False):
            lists = [np.frombuffer(k, "<u8") for k in b["keys"]]
            yield _post(number, b["doc_id"].to_numpy(np.int64), b["row"].to_numpy(np.int64), b["n"].to_numpy(np.int64), lists, parts)

    return sets.select("doc_id", "row", "n", "keys").mapInPandas(run, _MAIL)


class _Node:
    __slots__ = ("segment", "children", "ends", "least", "most", "rest", "sole")

    def __init__(self, segment: list[int], sole: int, n: int, rest: int) -> None:
        self.segment, self.children, self.ends = segment, {}, []
        self.least = self.most = n  # sizes of the sets below
        self.rest = rest  # most shingles of a set after this segment
        self.sole: int | None = sole  # a set below, if all of them are in one component


class PrefixTree:
    """Sets of ascending numbers under path-compressed prefixes, with a union-find over the stored sets."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.root: _Node | None = None

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, items: list[int], n: int) -> list[int]:
        """Store a set (its shared shingles, and its whole size); the stored sets it was linked to."""
        me = len(self.parent)
        self.parent.append(me)
        linked = self._probe(me, items, n) if self.root is not None else []
        self._insert(me, items, n)
        return linked

    def _probe(self, me: int, items: list[int], n: int) -> list[int]:
        own, linked, stack = set(items), [], [(self.root, 0)]
        while stack:
            node, have = stack.pop()
            if node.sole is None:
                below = {self.find(c.sole) if c.sole is not None else None for c in node.children.values()}
                below.update(self.find(e) for e, _ in node.ends)
                if len(below) == 1 and None not in below:
                    node.sole = next(iter(below))
            if node.sole is not None and self.find(node.sole) == self.find(me):
                continue
            if OF * node.most < NEAR * n or OF * n < NEAR * node.least:
                continue
            smallest = max(node.least, needed(n))
            overlap = -(-NEAR * (n + smallest) // (OF + NEAR))  # the least that links with a set of that size
            left = len(items) - bisect_right(items, node.segment[-1]) if node.segment else len(items)
            if have + min(len(node.segment) + node.rest, len(items)) < overlap:
                continue
            if node.segment:
                have += len(own.intersection(node.segment))
            if have + min(node.rest, left) < overlap:
                continue
            for other, size in node.ends:
                if self.find(other) != self.find(me) and OF * have >= NEAR * (n + size - have):
                    self.parent[self.find(me)] = self.find(other)
                    linked.append(other)
            stack.extend((c, have) for c in node.children.values())
        return linked

    def _insert(self, me: int, items: list[int], n: int) -> None:
        if self.root is None:
            self.root = _Node([], me, n, len(items))
        node, at = self.root, 0
        while True:
            node.least, node.most, node.rest = min(node.least, n), max(node.most, n), max(node.rest, len(items) - at)
            if node.sole is not None and self.find(node.sole) != self.find(me):
                node.sole = None
            if at == len(items):
                node.ends.append((me, n))
                return
            child = node.children.get(items[at])
            if child is None:
                child = node.children[items[at]] = _Node(items[at:], me, n, 0)
                child.ends.append((me, n))
                return
            seg, k = child.segment, 0
            while k < len(seg) and at + k < len(items) and seg[k] == items[at + k]:
                k += 1
            if k < len(seg):  # split the edge
                upper = _Node(seg[:k], child.sole if child.sole is not None else me, child.least, len(seg) - k + child.rest)
                upper.most = child.most
                upper.sole = child.sole
                child.segment = seg[k:]
                upper.children[seg[k]] = child
                node.children[items[at]] = upper
                child = upper
            node, at = child, at + k


def tree_links(keys: list[np.ndarray], sizes: list[int], ids: list[int]) -> list[tuple[int, int]]:
    """Links that connect the sets of one block as all their links do."""
    flat = np.concatenate(keys)
    values, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, -count))] = np.arange(len(values))  # shared shingles first: longer common prefixes
    ranks, at, tree, out = rank[where], 0, PrefixTree(), []
    lists = []
    for k in keys:
        lists.append(np.sort(ranks[at : at + len(k)]).tolist())
        at += len(k)
    order = sorted(range(len(lists)), key=lambda i: (sizes[i], ids[i]))
    for i in order:
        out += [(ids[i], ids[order[j]]) for j in tree.join(lists[i], sizes[i])]
    return out


def _tree_edges(reps: DataFrame) -> DataFrame:
    """Links among representatives with a min-hash in common, block by block."""
    grips = reps.select("row", F.posexplode("grip").alias("which", "grip"))
    groups = grips.groupBy("which", "grip").count().where("count > 1")
    placed = big_join(grips, groups, ["which", "grip"]).select(
        "row", "which", "grip", F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / BLOCK)).alias("block")
    )
    full = big_join(placed, reps.select("row", "doc_id", "n", "keys"), "row")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        links = tree_links([np.frombuffer(k, "<u8") for k in g["keys"]], g["n"].tolist(), g["doc_id"].tolist()) if len(g) > 1 else []
        return returned(pd.DataFrame(links, columns=["merge_id", "drop_id"], dtype=np.int64))

    return full.groupBy("which", "grip", "block").applyInPandas(run, "merge_id long, drop_id long")


def _labelled(reps: DataFrame, labels: DataFrame) -> DataFrame:
    found = labels.select(F.col("id").alias("doc_id"), F.col("comp").alias("found"))
    return big_join(reps, found, "doc_id", "left").withColumn("comp", F.coalesce("found", "doc_id")).drop("found")


def _rest_edges(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different components, by prefix shingles and the exact overlap."""
    rows = _labelled(reps.select("row", "doc_id", "n", "prefix", (F.length("keys") / 8).cast("long").alias("m")), labels)
    post = rows.select("row", "n", "comp", (F.col("n") - F.col("m")).alias("alone"), F.posexplode("prefix").alias("at", "key"))
    mixed_keys = post.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    post = big_join(post, mixed_keys, "key").select("key", "row", "n", "comp", (F.col("alone") + F.col("at")).alias("place"))
    a, b = post.alias("a"), post.alias("b")
    x_n, y_n = F.col("a.n"), F.col("b.n")
    overlap = F.ceil(NEAR * (x_n + y_n) / (OF + NEAR))
    # the first shingle that both prefixes hold has everything common at or after it, in either set
    reach = F.least(x_n - F.col("a.place"), y_n - F.col("b.place"))
    fits = (F.col("a.comp") < F.col("b.comp")) & (x_n * OF >= y_n * NEAR) & (y_n * OF >= x_n * NEAR) & (reach >= overlap)
    pairs = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & fits).select(F.col("a.row").alias("x"), F.col("b.row").alias("y")).distinct()
    side = lambda c: reps.select(F.col("row").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("doc_id", "n", "keys")))
    full = big_join(big_join(pairs, side("x"), "x"), side("y"), "y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, k, j, m, q in zip(b.x_doc_id, b.x_n, b.x_keys, b.y_doc_id, b.y_n, b.y_keys, strict=True):
                both = len(np.intersect1d(np.frombuffer(k, "<u8"), np.frombuffer(q, "<u8"), assume_unique=True))
                if OF * both >= NEAR * (n + m - both):
                    out.append((i, j))
            yield pd.DataFrame(out, columns=["merge_id", "drop_id"], dtype=np.int64)

    return full.drop("x", "y").mapInPandas(run, "merge_id long, drop_id long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id."""
    parts = shards(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)).alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").isNotNull().alias("known"))
    sets = written(_shared(_from_texts(rows, parts), parts).drop("grip", "prefix"), "ngram-sets")
    some = sets.where("keys IS NOT NULL")
    # copies: rows whose whole set is shared and the same
    whole = F.length("keys") == F.col("n") * 8
    kind = F.when(whole, F.sha2("keys", 256)).otherwise(F.col("row").cast("string"))
    kinds = some.select("doc_id", "row", kind.alias("kind"))
    first = kinds.groupBy("kind").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("n"))
    # a large group of copies meets its first in SALTS tasks
    several = first.where("n > 1").select("kind", "rep", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt"))
    salted = kinds.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    copies = big_join(salted, several, ["kind", "salt"]).where("doc_id != rep.doc_id")
    copies = copies.select(F.col("doc_id").alias("merge_id"), F.col("rep.doc_id").alias("drop_id"))
    reps = big_join(some.select("doc_id", "row", "n", "keys"), first.select(F.col("rep.row").alias("row")), "row")
    cores = written(_shared(_from_sets(reps, parts), parts, ordered=True).where("keys IS NOT NULL"), "ngram-cores")
    edges = written(_tree_edges(cores).unionByName(copies), "ngram-links")
    labels = connected_components(edges)
    rest = written(_rest_edges(cores, labels), "ngram-rest")
    if not rest.isEmpty():
        labels = connected_components(edges.unionByName(rest))
    out = _labelled(sets.select("doc_id", "row", "n"), labels)
    known = F.col("row") >= 0
    return out.select(F.when(known, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.col("comp")).alias("component_id"))
