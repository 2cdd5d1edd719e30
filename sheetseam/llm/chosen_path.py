"""Near duplicates by a chosen-path set similarity join.

Two texts link when ``100 * |x & y| >= 85 * |x | y|`` over their distinct three-word shingles (64-bit hashes of words lower-cased A-Z and split at
ASCII white space; a text of one or two words is one shingle).  The result is one row per input row: set size, smallest document
id that its links reach, and whether it is that document.

1. *Tokens.*  A text is embedded as ``TOKENS`` minwise values.  Texts with the same set are one class; only classes go on.
2. *Chosen paths.*  At each node of a tree a class picks every token with probability ``BRANCH / (0.85 * TOKENS)``, by a hash of node and token, and goes to
   the child node of each picked token.  Linked texts share two picked tokens in expectation, so a path survives to any depth with
   probability 0.797, and ``TREES`` independent trees reach ``TARGET`` recall even for a link at the threshold that sits in deep nodes.
3. *Small nodes* are compared exhaustively: every pair of different components that sizes, one bit of each token and a parity sketch of the sets
   (which never rules out a link) allow is decided on the full sets.
4. *Large nodes* are first cut into blocks that share a few members, which joins groups of near copies.  If few members are then outside the largest
   component, they are compared with all of it, block by block; else the node branches on.  What is still large at ``DEPTH`` is compared
   block against block, so no group is met in one task or left out.

The first trees are compared before the others start: a node whose members are known to be one component by then is left.  Until the end components
are known in part only (every task names the smallest member that it linked); that costs comparisons, not links.
A link in the results is always decided on full sets.  A link can be missed if no tree brings its texts together (probability ``1 - TARGET`` at most) or if
more than ``DIFFER`` bits of its tokens differ (below 2e-7 at the threshold).

Rows without words have no shingle and link nothing.  Null ids: the row is kept, with a null component, and links nothing.  Rows with the same id and
different texts are one node.  Repeated rows are kept.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import big_join, release
from .common import sized_join, written
from .packed import mixed, returned, word_hashes

WORDS, NEAR, OF = 3, 85, 100
TOKENS, BRANCH, TARGET = 64, 2.0, 0.99999
#: Most differences among one bit of each token of two texts that are looked at further (5 are expected at the threshold).
DIFFER = 18
#: Bits of the parity sketch: bit b is the parity of the shingles that hash to b, so that two sketches differ in no more bits than their sets do.
PARITY = 1024
#: Largest node that is compared as a whole, members that all blocks of a larger one share, and levels of a tree.
LIMIT, SHARED, DEPTH = 4000, 4, 5
#: Trees that are closed before the others start, and tasks that a group of copies is spread over.
FIRST, SALTS = 2, 16


def survival(branch: float) -> float:
    """Probability that a path of shared picks goes on to any depth."""
    p = 1.0
    for _ in range(200):
        p = 1 - math.exp(-branch * p)
    return p


TREES = math.ceil(math.log(1 - TARGET) / math.log(1 - survival(BRANCH)))
_FACTORS = mixed(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)
_HASHES = mixed(np.arange(1001, 1001 + TOKENS, dtype=np.uint64)) | np.uint64(1)
_PLACES = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
_PICKED = np.uint64(int(BRANCH * OF / (NEAR * TOKENS) * 2**64))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, begin = word_hashes([t or "" for t in texts])
    rolled = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k, f in enumerate(_FACTORS):
        rolled += h[k : k + len(rolled)] * f
    rolled, out = mixed(rolled), []
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        if j - i >= WORDS:
            out.append(np.unique(rolled[i : j - WORDS + 1]))
        else:  # fewer words: all of them are one shingle
            few = np.array([j - i], dtype=np.uint64)
            for x in h[i:j]:
                few = mixed(few ^ x)
            out.append(few[: int(j > i)])
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """``TOKENS`` mixed minwise values of each set (sets are not empty)."""
    out = np.empty((len(sets), TOKENS), dtype=np.uint64)
    if sets:
        flat, start = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
        for k, f in enumerate(_HASHES):
            out[:, k] = np.minimum.reduceat(flat * f, start)
    return mixed(out)


def picks(seeds: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes of the tokens that rows pick at the nodes named by ``seeds``."""
    x = mixed((tokens | _PLACES) ^ seeds[:, None])
    row, place = np.nonzero(x < _PICKED)
    return row, mixed(x[row, place] * np.uint64(0x9E3779B97F4A7C15) + seeds[row])


def _embedded(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets(b["text"].tolist())
            some = np.array([len(s) > 0 for s in sets], dtype=bool) & b["known"].to_numpy(bool)
            digest = np.full(len(b), None, dtype=object)
            tokens, parity, bits = digest.copy(), digest.copy(), np.zeros(len(b), dtype=np.int64)
            for i, t in zip(np.flatnonzero(some), minwise([sets[i] for i in np.flatnonzero(some)]), strict=True):
                digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                tokens[i] = (t >> np.uint64(32)).astype("<u4").tobytes()
                parity[i] = np.packbits(np.bincount((sets[i] % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()
                bits[i] = ((t & np.uint64(1)) << np.arange(TOKENS, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)
            yield returned(pd.DataFrame({"doc_id": b["doc_id"], "known": b["known"], "n": [len(s) for s in sets], "digest": digest, "tokens": tokens, "parity": parity, "bits": bits}))

    return docs.mapInPandas(run, "doc_id long, known boolean, n long, digest binary, tokens binary, parity binary, bits long")


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, TOKENS).astype(np.uint64)


def _first_level(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                tokens, cls = _tokens(b["tokens"]), b["cls"].to_numpy(np.int64)
                for tree in range(TREES):
                    row, node = picks(np.repeat(mixed(np.array([tree + 1], dtype=np.uint64)), len(b)), tokens)
                    yield pd.DataFrame({"node": node.view(np.int64), "tree": np.full(len(row), tree, np.int32), "cls": cls[row]})

    return classes.select("cls", "tokens").mapInPandas(run, "node long, tree int, cls long")


def _next_level(members: DataFrame, classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                row, node = picks(b["node"].to_numpy(np.int64).view(np.uint64), _tokens(b["tokens"]))
                yield pd.DataFrame({"node": node.view(np.int64), "cls": b["cls"].to_numpy(np.int64)[row]})

    return big_join(members, classes.select("cls", "tokens"), "cls").select("node", "cls", "tokens").mapInPandas(run, "node long, cls long")


def _several(members: DataFrame) -> DataFrame:
    """Members of nodes with more than one, with the node's size."""
    return big_join(members, members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node")


def _blocks() -> F.Column:
    return F.ceil(F.col("size") / LIMIT).cast("int")


def _units(members: DataFrame) -> DataFrame:
    """``node, block, cls``: small nodes are one unit; the blocks of a large one share a few of its members."""
    here = F.pmod(F.xxhash64("cls", "node"), _blocks()).cast("int")
    units = members.select("node", F.when(F.col("size") > LIMIT, here).otherwise(0).alias("block"), "cls")
    shared = members.where(F.col("size") > LIMIT).groupBy("node", F.pmod(F.xxhash64("cls"), F.lit(SHARED)).alias("k")).agg(F.min("cls").alias("cls"), F.max("size").alias("size"))
    everywhere = shared.select("node", F.explode(F.sequence(F.lit(0), _blocks() - 1)).alias("block"), "cls")
    return units.unionByName(everywhere)


def _against_most(members: DataFrame) -> DataFrame:
    """``node, block, cls``: the blocks of a node's largest component, each with all members outside it."""
    most = members.where("most").select("node", F.pmod(F.xxhash64("cls", "node"), _blocks()).cast("int").alias("block"), "cls")
    return most.unionByName(members.where("NOT most").select("node", F.explode(F.sequence(F.lit(0), _blocks() - 1)).alias("block"), "cls"))


def _cells(members: DataFrame) -> DataFrame:
    """``node, block, cls``: every pair of blocks of a node is a unit."""
    own = F.pmod(F.xxhash64("cls", "node"), _blocks()).cast("int")
    m = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), _blocks() - 1)))
    return m.select("node", (F.least("own", "other") * _blocks() + F.greatest("own", "other")).cast("int").alias("block"), "cls")


def _whole_units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by (node, block), cut between units, with the number of each row's unit."""
    rest = None
    for b in chain(batches, [None]):
        both = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
        if both is None or not len(both):
            continue
        node, block = both["node"].to_numpy(), both["block"].to_numpy()
        new = np.concatenate(([False], (node[1:] != node[:-1]) | (block[1:] != block[:-1])))
        cut = len(both) if b is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield both.iloc[:cut], np.cumsum(new[:cut])
        rest = both.iloc[cut:]


def _near(g: pd.DataFrame, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a unit, of different components, that may be links: positions, and a measure that is small for like sets."""
    parity = np.frombuffer(b"".join(g["parity"]), np.uint64).reshape(len(g), -1)
    n, comp = (g[c].to_numpy(np.int64) for c in ("n", "comp"))
    bits = g["bits"].to_numpy(np.int64).view(np.uint64)  # the count of a negative number would be that of its absolute value
    for d in range(1, len(unit)):
        same = unit[d:] == unit[:-d]
        if not same.any():
            return
        a = np.flatnonzero(same & (np.bitwise_count(bits[d:] ^ bits[:-d]) <= DIFFER))
        b = a + d
        fits = (comp[a] != comp[b]) & (OF * np.minimum(n[a], n[b]) >= NEAR * np.maximum(n[a], n[b]))
        a, b = a[fits], b[fits]
        if len(a):
            differ = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
            fits = (OF + NEAR) * differ <= (OF - NEAR) * (n[a] + n[b])
            yield a[fits], b[fits], differ[fits] / (n[a] + n[b])[fits]


_CLASS = "node long, block int, cls long, rep long, n long, comp long, parity binary, bits long"


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g, unit in _whole_units(batches):
        hit = np.zeros(len(g), dtype=bool)
        for a, b, _ in _near(g, unit):
            hit[a] = hit[b] = True
        yield g[hit]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for g, unit in _whole_units(batches):
        pairs = list(_near(g, unit))
        if pairs:
            a, b, apart = (np.concatenate(x) for x in zip(*pairs, strict=True))
            n, comp = (g[c].to_numpy(np.int64) for c in ("n", "comp"))
            keys = [np.frombuffer(k, "<u8") for k in g["keys"]]
            for k in np.argsort(apart, kind="stable"):
                i, j = int(a[k]), int(b[k])
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x == y:
                    continue
                both = len(np.intersect1d(keys[i], keys[j], assume_unique=True))
                if OF * both >= NEAR * (n[i] + n[j] - both):
                    parent[max(x, y)] = min(x, y)
    out = [(find(x), x) for x in list(parent) if find(x) != x]
    yield returned(pd.DataFrame(out, columns=["merge_id", "drop_id"], dtype=np.int64))


class _Join:
    """The state of a join: classes with their component so far, the full sets asked for so far, and the links found."""

    def __init__(self, docs: DataFrame, classes: DataFrame, links: DataFrame) -> None:
        self.docs, self.classes, self.parts = docs, classes, max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.sets, self.links, self.labelled = [], [links], classes.withColumn("comp", F.col("rep"))

    def add(self, links: DataFrame) -> None:
        """More links between components: each goes to the smallest one that a task linked it to, and on to where that one went."""
        self.links.append(links)
        to = links.groupBy(F.col("drop_id").alias("comp")).agg(F.min("merge_id").alias("to"))
        ahead = to.select(F.col("comp").alias("to"), F.col("to").alias("further"))
        to = big_join(to, ahead, "to", "left").select("comp", F.coalesce("further", "to").alias("to"))
        info = self.labelled.select("cls", "rep", "n", "parity", "bits", "comp")
        self.labelled = written(big_join(info, to, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"), "path-labels")

    def components(self) -> DataFrame:
        """``cls, comp``: the classes with the smallest id of their whole component."""
        labels = connected_components(_all(self.links)).select(F.col("id").alias("rep"), F.col("comp").alias("found"))
        return big_join(self.classes.select("cls", "rep"), labels, "rep", "left").select("cls", F.coalesce("found", "rep").alias("comp"))

    def mixed_nodes(self, members: DataFrame) -> DataFrame:
        """Members of nodes that are not one component already; ``most`` marks the largest component, ``others`` counts the rest."""
        comps = big_join(members.select("node", "cls", "size"), self.labelled.select("cls", "comp"), "cls")
        counts = comps.groupBy("node", "comp").agg(F.count("*").alias("c"))
        top = counts.groupBy("node").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).where(F.col("all") > F.col("top.c"))
        both = big_join(comps, top, "node")
        return both.select("node", "cls", "size", (F.col("comp") == F.col("top.comp")).alias("most"), (F.col("all") - F.col("top.c")).alias("others"))

    def full_sets(self, wanted: DataFrame) -> DataFrame:
        """``cls, keys`` of the classes asked for (cls, rep), from the texts of their first documents."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sets = [s.tobytes() for s in shingle_sets(b["text"].tolist())]
                digest = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield returned(pd.DataFrame({"doc_id": b["doc_id"], "digest": digest, "keys": sets}))

        if self.sets:
            wanted = wanted.join(_all([s.select("cls") for s in self.sets]).hint("merge"), "cls", "left_anti")
        wanted = written(wanted.distinct(), "path-wanted")
        if not wanted.isEmpty():
            texts = sized_join(self.docs.where("known").select("doc_id", "text"), wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
            sets = texts.mapInPandas(run, "doc_id long, digest binary, keys binary").withColumn("cls", F.xxhash64("digest"))
            sets = big_join(sets, wanted.select("cls", F.col("rep").alias("doc_id")), ["cls", "doc_id"])
            self.sets.append(written(sets.groupBy("cls", "doc_id").agg(F.min("keys").alias("keys")).drop("doc_id"), "path-sets"))  # repeated rows
        release(wanted)
        return _all(self.sets)

    def compare(self, units: DataFrame) -> None:
        """Find the links inside units and close the components."""
        together = lambda df: df.repartition(self.parts, "node", "block").sortWithinPartitions("node", "block")
        info = big_join(units, self.labelled, "cls").select(*(c.split()[0] for c in _CLASS.split(", ")))
        flagged = written(together(info).mapInPandas(_possible, _CLASS), "path-possible")
        if not flagged.isEmpty():
            sets = self.full_sets(flagged.select("cls", "rep"))
            links = written(together(big_join(flagged, sets, "cls")).mapInPandas(_linked, "merge_id long, drop_id long"), "path-links")
            if not links.isEmpty():
                self.add(links)
        release(flagged)

    def grow(self, members: DataFrame) -> None:
        """All levels of all trees, from the members of their first nodes."""
        first = members.where(F.col("tree") < FIRST)
        self.compare(_units(first))
        members = written(self.mixed_nodes(members.where((F.col("tree") >= FIRST) | (F.col("size") > LIMIT))), "path-nodes")
        units = _units(members)
        for _ in range(DEPTH):
            self.compare(units)
            large = members.where(F.col("size") > LIMIT)
            if large.isEmpty():
                return
            large = written(self.mixed_nodes(large), "path-large")
            if large.isEmpty():
                return
            members = written(_several(written(_next_level(large.where(F.col("others") > LIMIT), self.classes), "path-members")), "path-nodes")
            units = _units(members).unionByName(_against_most(large.where(F.col("others") <= LIMIT)))
        self.compare(_cells(members).unionByName(_against_most(large.where(F.col("others") <= LIMIT))))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    named = F.col(f"`{doc_id}`").cast("long")
    docs = docs.select(F.coalesce(named, F.lit(0)).alias("doc_id"), named.isNotNull().alias("known"), F.col(f"`{text}`").alias("text"))
    rows = written(_embedded(docs), "path-rows")
    some = rows.where("digest IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min("tokens").alias("tokens"), F.min("parity").alias("parity"), F.min("bits").alias("bits"))
    classes = written(classes.withColumn("cls", F.xxhash64("digest")), "path-classes")
    # an id with several texts joins their classes
    ids = some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("doc_id")
    torn = big_join(some.select("doc_id", "digest"), ids, "doc_id").distinct()
    own = written(big_join(torn, classes.select("digest", "rep"), "digest").select(F.col("rep").alias("merge_id"), F.col("doc_id").alias("drop_id")), "path-ids")
    join = _Join(docs, classes, own)
    trees = written(_several(written(_first_level(classes), "path-members")), "path-members")
    join.grow(trees)
    release(trees)

    comps = big_join(classes.select("digest", "copies", "rep", "cls"), join.components(), "cls")
    more = comps.where("copies > 1 OR comp != rep").select("digest", "comp", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt"))
    salted = rows.select("doc_id", "known", "n", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = big_join(salted, more, ["digest", "salt"], "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    known = F.when(F.col("known"), F.col("doc_id"))
    return out.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("comp")).alias("component_id"), (~F.col("known") | (F.col("doc_id") == F.col("comp"))).alias("kept"))
