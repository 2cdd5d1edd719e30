"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text.  The model knows every training word and
one unseen word.  Three-word probabilities interpolate down to the single word:

    p(w | u v) = L(c(u v)) * c(u v w) / c(u v) + (1 - L) * p(w | v),   L(c) = 1 / (1 + KAPPA * c ** -0.1)

and likewise ``p(w | v)`` with the one-word probability ``(c + 0.5) / (N + 0.5 (V + 1))``; every context sums to one.  (Counts of a context's different
successors grow about as c ** 0.9, so L is close to Witten-Bell with a weight of KAPPA, from the context's count alone.)

The ``2**19`` most frequent words have a number and exact counts in a bounded table that every task holds; n-grams of numbered words travel as one
packed key.  Other words are known by their hash: their n-grams travel as three names, a shard numbers the words that it meets, and asks the
table of all words (dealt by hash) for the counts of those that end a training n-gram.  Both kinds make one trie.

N-grams of all texts go to shards by their context, as packed arrays.  A shard counts those of the training texts and builds its part of
the trie: per level the child ids as an Elias-Fano sequence made monotone by the parent's number, Elias-Fano pointers to each parent's
children, and 16-bit quantised log probabilities and back-off weights.  The levels lie in one memory-mapped file; queries are
answered by a search for the successor within the range of their context.

Frequent words (seen in more than one of ``1 / HOT_SHARE`` tokens of a sample) would make hot shards.  The n-grams of a frequent ``v`` are dealt by the
pair; if both are frequent, by pair and successor, with the pair's total from a table bounded by their number.  What follows a frequent ``v`` is then in
many shards, so its pairs ``v w`` are counted elsewhere: those of two frequent words, and with the end, in that table, the others in shards by pair, which
answer every shard that scores such a pair.  So the choice of frequent words decides where n-grams are counted, not what the model knows.  Without
``all_pairs`` the model leaves these pairs out and goes from the context of two words straight to the single word.

A null text is empty: one end.  Rows with a null id are scored but not learned from.  Without training texts every
token is unseen with probability 1.  Repeated rows count each time.  The rows must come in the same order if a task is repeated.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shards, written
from .packed import by_shard, mixed, pack_sorted, returned, unpack_sorted, word_hashes

TOP_BITS, ID_BITS = 19, 20
TOP = 1 << TOP_BITS
TAIL, END, START = TOP, TOP + 1, TOP + 2
#: From here on a shard numbers the words that have no number of their own.
LOCAL = TOP + 3
KAPPA, HOT_SHARE, SAMPLE = 8.0, 1e-3, 2000
PAIRS = 2 << 20  # tokens after frequent words whose pairs one shard counts
STEP = 1024  # quantisation of log10: 1/1024
_ID = np.uint64(ID_BITS)
_MASK = np.uint64((1 << ID_BITS) - 1)


def weight(c: np.ndarray) -> np.ndarray:
    return 1 / (1 + KAPPA * np.maximum(c, 1) ** -0.1)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype("<u2")


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; read by position or searched by value."""

    @staticmethod
    def packed(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n * low, dtype=np.uint8)
        for k in range(low):
            bits[k::low] = (values >> np.uint64(k)).astype(np.uint8) & 1
        high = np.zeros(n + (top >> low) + 1, dtype=np.uint8)
        high[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        head = np.array([n, low], dtype="<i8")
        return [head.view(np.uint8), np.append(np.packbits(bits, bitorder="little"), np.zeros(8, np.uint8)), np.packbits(high, bitorder="little")]

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits = (int(x) for x in head.view("<i8"))
        self.low = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low.data, strides=(1,))
        self.ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))  # directory for positions, held while open

    def at(self, i: np.ndarray) -> np.ndarray:
        high = (self.ones[i] - i).astype(np.uint64) << np.uint64(self.low_bits)
        bit = i * self.low_bits
        low = (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return high | low

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position of each x within its own range, -1 if it is not there: successor search by halving."""
        lo, end = lo.copy(), hi
        hi = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.at(mid) < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(lo < end)
        same = inside[self.at(lo[inside]) == x[inside]]
        found[same] = lo[same]
        return found


@dataclass
class After:
    """Pairs of a frequent word and its successor with their counts (ordered, each once), and how often each frequent word is followed."""

    v: np.ndarray
    w: np.ndarray
    count: np.ndarray
    totals: dict[int, int]

    @classmethod
    def none(cls) -> After:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), {})


class Trie:
    """Memory-mapped levels: contexts v and (v, u), their successors w, quantised values."""

    NAMES = ("v", "v_back", "w2_first", "w2", "p2", "u_first", "u", "u_back", "w3_first", "w3", "p3")
    PLAIN = frozenset(("v_back", "p2", "u_back", "p3"))

    @classmethod
    def build(cls, keys: np.ndarray, count: np.ndarray, log_p1: np.ndarray, hot: int, pair_totals: dict[int, int], asked: np.ndarray) -> Trie:
        """From sorted keys ``v | u | w`` with their training counts.  Pairs of frequent words that are asked for are
        contexts here even if all of their successors are in other shards."""
        return cls.of_words(*_words(keys), count, log_p1, hot, pair_totals, *_words(asked)[:2])

    @classmethod
    def of_words(
        cls, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, log_p1: np.ndarray, hot: int, pair_totals: dict[int, int], asked_v: np.ndarray, asked_u: np.ndarray,
        after: After | None = None,
    ) -> Trie:
        """The same from three columns in the order of (v, u, w); ``log_p1`` has a row for every number."""
        bits = max(ID_BITS, len(log_p1).bit_length())
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        both = is_hot(asked_v, hot) & is_hot(asked_u, hot)
        pairs = np.unique(asked_v[both] << _ID | asked_u[both])
        pairs = np.array([p for p in pairs.tolist() if pair_totals.get(p)], dtype=np.uint64)
        p1 = 10.0 ** log_p1
        after = after or After.none()
        vs = np.unique(np.concatenate([v, pairs >> _ID, np.array([x for x in np.unique(asked_v[is_hot(asked_v, hot)]).tolist() if after.totals.get(x)], dtype=v.dtype)]))
        v_at = np.searchsorted(vs, v)
        frequent = is_hot(vs, hot)
        # two-word level: the successors of frequent words are not all here, those of the others are
        plain = np.flatnonzero(~frequent[v_at])
        pair, pair_at = np.unique(v_at[plain].astype(np.uint64) << shift | w[plain], return_inverse=True)
        c2 = np.bincount(pair_at, weights=count[plain], minlength=len(pair))
        total2 = np.bincount((pair >> shift).astype(np.int64), weights=c2, minlength=len(vs))
        total2[frequent] = [after.totals.get(x, 0) for x in vs[frequent].tolist()]
        l2 = np.where(total2 > 0, weight(total2), 0.0)
        pair, c2 = np.append(pair, np.searchsorted(vs, after.v).astype(np.uint64) << shift | after.w), np.append(c2, after.count)
        order = np.argsort(pair, kind="stable")
        pair, c2, place = pair[order], c2[order], np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        parent2 = (pair >> shift).astype(np.int64)
        w2 = (pair & mask).astype(np.int64)
        prob2 = l2[parent2] * c2 / np.maximum(total2[parent2], 1) + (1 - l2[parent2]) * p1[w2]
        # three-word level
        u_of = v_at.astype(np.uint64) << shift | u
        us = np.unique(np.concatenate([u_of, np.searchsorted(vs, pairs >> _ID).astype(np.uint64) << shift | pairs & _MASK]))
        u_at = np.searchsorted(us, u_of)
        total3 = np.bincount(u_at, weights=count, minlength=len(us))
        u_parent = (us >> shift).astype(np.int64)
        own_v, own_u = vs[u_parent], us & mask
        for k in np.flatnonzero(is_hot(own_v, hot) & is_hot(own_u, hot)):
            total3[k] = pair_totals[int(own_v[k]) << ID_BITS | int(own_u[k])]
        l3 = weight(total3)
        lower = p1[w.astype(np.int64)]
        lower[plain] = prob2[place[pair_at]]
        if len(after.v):
            rest = np.flatnonzero(frequent[v_at])
            own = v_at[rest].astype(np.uint64) << shift | w[rest]
            at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            there = pair[at] == own
            lower[rest[there]] = prob2[at[there]]
        prob3 = l3[u_at] * count / total3[u_at] + (1 - l3[u_at]) * lower
        first = lambda parent, n: np.searchsorted(parent, np.arange(n + 1))
        log = lambda x: quantised(np.log10(np.maximum(x, 1e-60)))
        return cls._mapped({
            "v": vs, "v_back": log(1 - l2), "w2_first": first(parent2, len(vs)), "w2": pair, "p2": log(prob2),
            "u_first": first(u_parent, len(vs)), "u": us, "u_back": log(1 - l3),
            "w3_first": first(u_at, len(us)), "w3": u_at.astype(np.uint64) << shift | w, "p3": log(prob3),
        }, bits)

    @classmethod
    def _mapped(cls, levels: dict[str, np.ndarray], bits: int) -> Trie:
        """Lay the levels out in one file without a name (nothing stays behind) and map it."""
        with tempfile.TemporaryFile() as f:
            places, at = {}, 0
            for name in cls.NAMES:
                parts = [levels[name]] if name in cls.PLAIN else EliasFano.packed(levels[name])
                places[name] = []
                for p in parts:
                    raw = p.tobytes()
                    f.write(raw + b"\0" * (-len(raw) % 8 or 8))
                    places[name].append((at, len(raw)))
                    at += len(raw) + (-len(raw) % 8 or 8)
            f.flush()
            return cls(np.memmap(f, dtype=np.uint8, mode="r", shape=(at,)), places, bits)

    def __init__(self, file: np.ndarray, places: dict[str, list[tuple[int, int]]], bits: int) -> None:
        self.shift = np.uint64(bits)
        for name in self.NAMES:
            parts = [file[a : a + n] for a, n in places[name]]
            setattr(self, name, parts[0].view("<u2") if name in self.PLAIN else EliasFano(*parts))

    def log10(self, keys: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        """log10 p(w | u v) of each key ``v | u | w``."""
        return self.log10_of(*_words(keys), log_p1)

    def log10_of(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v))
        top = self.v.find(v, np.zeros(len(v), np.int64), np.full(len(v), self.v.n, np.int64))
        known = np.flatnonzero(top >= 0)
        node = top[known]
        pair = self.u.find(
            node.astype(np.uint64) << self.shift | u[known], self.u_first.at(node).astype(np.int64), self.u_first.at(node + 1).astype(np.int64)
        )
        deep = np.flatnonzero(pair >= 0)
        at = pair[deep]
        three = self.w3.find(
            at.astype(np.uint64) << self.shift | w[known[deep]], self.w3_first.at(at).astype(np.int64), self.w3_first.at(at + 1).astype(np.int64)
        )
        out[known[deep]] = np.where(three >= 0, -(self.p3[three] / STEP) if len(self.p3) else 0.0, -(self.u_back[at] / STEP))
        done = np.zeros(len(v), dtype=bool)
        done[known[deep[three >= 0]]] = True
        rest = np.flatnonzero(~done[known])
        todo = known[rest]
        node = node[rest]
        two = self.w2.find(
            node.astype(np.uint64) << self.shift | w[todo], self.w2_first.at(node).astype(np.int64), self.w2_first.at(node + 1).astype(np.int64)
        )
        out[todo] += np.where(two >= 0, -(self.p2[two] / STEP) if len(self.p2) else 0.0, -(self.v_back[node] / STEP))
        done[todo[two >= 0]] = True
        out[~done] += log_p1[w[~done].astype(np.int64)]
        return out


def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three numbers of packed keys ``v | u | w``."""
    return keys >> (_ID + _ID), (keys >> _ID) & _MASK, keys & _MASK


def is_hot(ids: np.ndarray, hot: int) -> np.ndarray:
    """Frequent words have the first ids; the start of a text is as frequent."""
    return (ids < hot) | (ids == START)


@dataclass
class Vocabulary:
    """Exact counts of the most frequent words (sorted by hash) and what is known of the rest."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # by id
    hot: int
    pair_totals: dict[int, int]
    tokens: int
    kinds: int
    texts: int
    tail_tokens: int
    tail_kinds: int
    all_pairs: bool = False  # does the model keep the pairs of frequent words and their successors?

    def follow(self, w: np.ndarray) -> np.ndarray:
        """Are the pairs of a frequent word and ``w`` in the table of pair totals?"""
        return is_hot(w, self.hot) | (w == END)

    @property
    def wide(self) -> bool:
        """Are there training words without a number?"""
        return self.tail_kinds > 0

    @property
    def norm(self) -> float:
        return self.tokens + 0.5 * (self.kinds + 1)

    def id_of(self, words: np.ndarray) -> np.ndarray:
        """Ids of word hashes; each different word is looked up once."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), TAIL, dtype=np.int64)
        some, where = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        return np.where(self.hashes[at] == some, self.ids[at], TAIL)[where]

    def log_p1(self) -> np.ndarray:
        """log10 probability by id; the rare words' class as a whole."""
        out = np.full(TOP + 3, -60.0)
        out[: len(self.counts)] = np.log10((self.counts + 0.5) / self.norm)
        out[TAIL] = np.log10((self.tail_tokens + 0.5 * (self.tail_kinds + 1)) / self.norm)
        out[END] = np.log10((self.texts + 0.5) / self.norm) if self.texts else out[TAIL]
        return out


def _cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    cut = np.searchsorted(by_shard(keys, parts), np.arange(parts + 1))
    return ((s, int(i), int(j)) for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i)


def _vocabulary_table(learn: DataFrame, hot_words: np.ndarray, parts: int) -> DataFrame:
    """Per shard the sorted word hashes with their counts; shard -1: totals of pairs of frequent words; -2: number of texts."""
    frequent = learn.sparkSession.sparkContext.broadcast(hot_words)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = frequent.value
        held: list[np.ndarray] = []
        pairs: dict[int, int] = {}
        texts = have = 0
        columns = ["shard", "hashes", "counts"]

        def out() -> pd.DataFrame:
            some, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pd.DataFrame([(s, pack_sorted(some[i:j]), n[i:j].astype("<i8").tobytes()) for s, i, j in _cut(some, parts)], columns=columns)

        for b in batches:
            h, begin = word_hashes([t or "" for t in b["text"]])
            held.append(h)
            have += len(h)
            texts += len(b)
            line = np.full(len(h) + len(b), -1)  # frequent words and ends in one row
            end = begin[1:] + np.arange(len(b))
            line[end] = len(hot)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                line[np.arange(len(h)) + np.repeat(np.arange(len(b)), np.diff(begin))] = np.where(hot[at] == h, at, -1)
            before = np.append(-1, line)[:-1]
            before[end - np.diff(begin)] = len(hot)  # the first of a text follows the start
            both = np.flatnonzero((line >= 0) & (before >= 0))
            which, n = np.unique(before[both] * (len(hot) + 1) + line[both], return_counts=True)
            for k, m in zip(which.tolist(), n.tolist(), strict=True):
                pairs[k] = pairs.get(k, 0) + m
            if have > 4 << 20:
                yield out()
                have = 0
        yield out()
        both = np.array(sorted(pairs), dtype=np.uint64)
        yield pd.DataFrame([(-1, pack_sorted(both), np.array([pairs[int(k)] for k in both], dtype="<i8").tobytes()), (-2, pack_sorted(np.zeros(1, np.uint64)), np.array([texts], dtype="<i8").tobytes())], columns=columns)

    def total(g: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([unpack_sorted(x) for x in g["hashes"]])
        n = np.concatenate([np.frombuffer(x, "<i8") for x in g["counts"]])
        some, where = np.unique(h, return_inverse=True)
        sums = np.bincount(where, weights=n, minlength=len(some)).astype("<i8")
        return pd.DataFrame({"shard": [g["shard"].iloc[0]], "hashes": [pack_sorted(some)], "counts": [sums.tobytes()]})

    sent = learn.select("text").mapInPandas(send, "shard int, hashes binary, counts binary")
    return sent.groupBy("shard").applyInPandas(total, "shard int, hashes binary, counts binary")


def _frequent(learn: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that make up more than HOT_SHARE of the tokens of a bounded sample of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, n = np.unique(word_hashes([t or "" for t in b["text"]])[0], return_counts=True)
            yield pd.DataFrame({"h": h.astype(np.int64), "n": n})

    size = learn.count()
    if not size:
        return np.zeros(0, np.uint64)
    parts = 1 << 30
    some = learn.select("text").where(F.pmod(F.xxhash64("text"), F.lit(parts)) < min(parts, SAMPLE * parts // size + 1)).limit(4 * SAMPLE)
    found = some.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = written(found, "lm-sample")
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("n") > HOT_SHARE * total).select("h").collect()  # fewer than 1 / HOT_SHARE
    return np.sort(np.array([r.h for r in rows], dtype=np.int64).astype(np.uint64))


def _vocabulary(counted: DataFrame, hot_words: np.ndarray) -> Vocabulary:
    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["counts"]:
                c, n = np.unique(np.frombuffer(x, "<i8"), return_counts=True)
                yield pd.DataFrame({"c": c, "n": n})

    words = counted.where("shard >= 0")
    by_count = words.mapInPandas(histogram, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c"))
    kinds = tokens = top = 0
    least = 1 << 62
    full = False
    for r in by_count.toLocalIterator():
        kinds += r.n
        tokens += r.n * r.c
        if not full and top + r.n <= TOP:
            top, least = top + r.n, r.c
        else:
            full = True
    hot = np.sort(hot_words)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, c in zip(b["hashes"], b["counts"], strict=True):
                h, c = unpack_sorted(h), np.frombuffer(c, "<i8")
                some = (c >= least) & ~np.isin(h, hot) | np.isin(h, hot)
                yield pd.DataFrame({"h": [h[some].tobytes()], "c": [c[some].tobytes()]})

    hs, cs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in words.mapInPandas(keep, "h binary, c binary").toLocalIterator():  # at most TOP words
        hs.append(np.frombuffer(r.h, "<u8"))
        cs.append(np.frombuffer(r.c, "<i8"))
    h, c = np.concatenate(hs), np.concatenate(cs)
    order = np.lexsort((h, -c, ~np.isin(h, hot)))[:TOP]  # frequent words of the sample first
    h, c = h[order], c[order]
    ids = np.arange(len(h))
    pairs: dict[int, int] = {}
    texts = 0
    for r in counted.where("shard < 0").collect():
        k, n = unpack_sorted(r["hashes"]), np.frombuffer(r["counts"], "<i8")
        if r["shard"] == -2:
            texts = int(n[0])
        else:
            number = {int(x): i for i, x in enumerate(h[: len(hot)])}
            of = [number.get(int(x), TAIL) for x in hot]
            pairs = {[*of, END][int(x) % (len(hot) + 1)] << ID_BITS | [*of, START][int(x) // (len(hot) + 1)]: int(m) for x, m in zip(k, n, strict=True)}
    pairs[START << ID_BITS | START] = texts
    by_hash = np.argsort(h)
    known = int(c.sum())
    return Vocabulary(h[by_hash], ids[by_hash], c, min(len(hot), len(h)), pairs, tokens + texts, kinds + bool(texts), texts, tokens - known, kinds - len(h))


@dataclass
class Grams:
    """The n-grams of a batch of texts: numbers and names (the number, or the hash of a word without one) of ``v, u, w``, and whose they are."""

    ids: tuple[np.ndarray, np.ndarray, np.ndarray]
    names: tuple[np.ndarray, np.ndarray, np.ndarray] | None  # only if there are training words without a number
    of: np.ndarray
    route: np.ndarray

    @classmethod
    def of_texts(cls, voc: Vocabulary, h: np.ndarray, begin: np.ndarray, word: np.ndarray) -> Grams:
        """N-grams with one context have one route (those of two frequent words go by all three)."""
        n, size = len(begin) - 1, np.diff(begin)
        # words and ends in one row, with two starts before each text
        at = np.arange(len(h)) + 3 * np.repeat(np.arange(n), size) + 2
        line = np.full(len(h) + 3 * n, START, dtype=np.uint64)
        line[at] = word
        ends = begin[1:] + 3 * np.arange(n) + 2
        line[ends] = END if voc.texts else TAIL
        spot = np.sort(np.concatenate([at, ends]))
        v, u, w = ids = tuple(line[spot - k] for k in (1, 2, 0))
        names = None
        if voc.wide:
            line[at] = np.where(word == TAIL, h, word.astype(np.uint64))
            names = tuple(line[spot - k] for k in (1, 2, 0))
        nv, nu, nw = names or ids
        hot_v, hot_u = is_hot(v, voc.hot), is_hot(u, voc.hot)
        pair = (v << _ID) + nu
        if names is None and voc.all_pairs:
            hot_u = hot_u | (u == TAIL)  # never seen before any v, so nothing of its contexts is counted
        three = (pair << _ID) + nw
        if voc.all_pairs:  # one shard asks for a pair, whichever frequent word it follows
            three = np.where((v == START) | voc.follow(w), three, pair_keys(v, nw))
        route = mixed(np.where(hot_v, np.where(hot_u, three, pair | np.uint64(1 << 62)), nv | np.uint64(1 << 63)))
        return cls(ids, names, np.repeat(np.arange(n), size + 1), route)

    def asked(self, voc: Vocabulary) -> np.ndarray:
        """N-grams whose pair ``v w`` is counted in another shard."""
        v, _, w = self.ids
        some = is_hot(v, voc.hot) & (v != START) & ~voc.follow(w)
        return some if voc.wide else some & (w != TAIL)

    def without_number(self) -> np.ndarray:
        return (self.ids[0] == TAIL) | (self.ids[1] == TAIL) | (self.ids[2] == TAIL)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the columns (the first one counts most), and where a new row begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, np.flatnonzero(new)


_MAIL = "shard int, batch long, kind int, meta binary, keys binary, of binary, times binary, learn binary"


def _mail(rows: DataFrame, vocabulary, parts: int) -> DataFrame:
    """What shards need of a batch of texts.  Kinds: 0 n-grams as packed keys, 1 words to look up, 2 the batch itself, 3 n-grams as three names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc: Vocabulary = vocabulary.value
        log_p1, number = voc.log_p1(), TaskContext.get().partitionId() << 40
        columns = [c.split()[0] for c in _MAIL.split(", ")]
        for b in batches:
            h, begin = word_hashes([t or "" for t in b["text"]])
            n = len(b)
            size = np.diff(begin)
            doc = np.repeat(np.arange(n), size)
            word = voc.id_of(h)
            grams = Grams.of_texts(voc, h, begin, word)
            (v, u, w), of, route = grams.ids, grams.of, grams.route
            learn = np.packbits(b["learn"].to_numpy(bool)).tobytes()
            out = []

            def send(kind: int, keys, pack, of: np.ndarray, times: np.ndarray, route: np.ndarray) -> None:
                shard = by_shard(route, parts)
                order = np.argsort(shard, kind="stable")
                of, times, shard = of[order].astype("<u2"), times[order].astype("<u4"), shard[order]
                keys = tuple(k[order] for k in keys)
                cut = np.searchsorted(shard, np.arange(parts + 1))
                for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                    if j > i:
                        out.append((s, number, kind, None, pack(*(k[i:j] for k in keys)), of[i:j].tobytes(), times[i:j].tobytes(), learn))

            if voc.wide:
                some = grams.without_number()
                loose = np.zeros(n)
                names, whose, where = tuple(x[some] for x in grams.names), of[some], route[some]
                order, start = _distinct(*names, whose)
                one = order[start]
                send(3, tuple(x[one] for x in names), lambda *k: b"".join(x.tobytes() for x in k), whose[one], np.diff(np.append(start, len(order))), where[one])
                kept = ~some
            else:  # words without a number are unseen, and so is all that follows them
                alone = (v == TAIL) | is_hot(v, voc.hot) & (u == TAIL) & (not voc.all_pairs)
                loose = np.bincount(of[alone], weights=log_p1[w[alone].astype(np.int64)], minlength=n)
                kept = ~alone
            key = (v << (_ID + _ID) | u << _ID | w)[kept]
            of, route = of[kept], route[kept]
            order, start = _distinct(key, of)
            one = order[start]
            send(0, (key[one],), pack_sorted, of[one], np.diff(np.append(start, len(key))), route[one])
            # exact counts: frequent words and ends here, the others from their shard
            top = word != TAIL
            base = np.bincount(doc[top], weights=log_p1[word[top]], minlength=n) + (log_p1[END] if voc.texts else np.log10(0.5 / voc.norm))
            known = np.bincount(doc[top], minlength=n) + bool(voc.texts)
            rare, rare_of = h[~top], doc[~top]
            order = np.lexsort((rare_of, rare))
            rare, rare_of = rare[order], rare_of[order]
            for s, i, j in _cut(rare, parts):
                out.append((s, number, 1, None, pack_sorted(rare[i:j]), rare_of[i:j].astype("<u2").tobytes(), None, None))
            meta = np.stack([b["key"].to_numpy(np.int64), b["nokey"].to_numpy(np.int64), size + 1, known, base.view(np.int64), loose.view(np.int64)]).astype("<i8").tobytes()
            out.append((number % parts, number, 2, meta, None, None, None, None))
            yield returned(pd.DataFrame(out, columns=columns))
            number += 1 << 16

    return rows.mapInPandas(run, _MAIL)


def pair_keys(v: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Key of a frequent word's number and the name of its successor."""
    return mixed(mixed(name + np.uint64(1)) + v)


_WORDS = "shard int, hashes binary, counts binary, pairs boolean"


def _counts_for_shards(rows: DataFrame, words: DataFrame, vocabulary, parts: int, counters: int) -> DataFrame:
    """``shard, hashes, counts`` of the words without a number that end training n-grams of the shard, and (``pairs``) of the pairs after
    frequent words that end any of its n-grams.  Pairs are counted in ``counters`` shards of their own, a number that goes by the tokens:
    each of them answers every shard, so more of them would only cut the answers smaller."""
    columns = ["shard", "hashes", "to", "counts"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc: Vocabulary = vocabulary.value
        held: list[tuple] = []
        pairs: list[tuple] = []
        have = 0

        def out() -> pd.DataFrame:
            asked, to = (np.concatenate(x) for x in zip(*held, strict=True))
            order, start = _distinct(asked, to)
            asked, to = asked[order[start]], to[order[start]].astype("<i4")
            rows = [(s, pack_sorted(asked[i:j]), to[i:j].tobytes(), None) for s, i, j in _cut(asked, parts)]
            key, to, n = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order, start = _distinct(key, to)
            n = np.add.reduceat(n[order], start).astype("<i4") if len(n) else n
            key, to = key[order[start]], to[order[start]].astype("<i4")
            rows += [(parts + s, pack_sorted(key[i:j]), to[i:j].tobytes(), n[i:j].tobytes()) for s, i, j in _cut(key, counters)]
            held.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=columns)

        for b in batches:
            h, begin = word_hashes([t or "" for t in b["text"]])
            grams = Grams.of_texts(voc, h, begin, voc.id_of(h))
            learn = b["learn"].to_numpy(bool)[grams.of]
            names, shard = grams.names or grams.ids, by_shard(grams.route, parts)
            after = grams.asked(voc) & voc.all_pairs
            last = np.flatnonzero((grams.ids[2] == TAIL) & (learn | after) & voc.wide)
            order, start = _distinct(names[2][last], shard[last])
            last = last[order[start]]
            held.append((names[2][last], shard[last]))
            some = np.flatnonzero(after)
            pairs.append((pair_keys(grams.ids[0][some], names[2][some]), shard[some].astype("<i4"), learn[some].astype("<i4")))
            have += len(last) + len(some)
            if have > 2 << 20:
                yield returned(out())
                have = 0
        if held:
            yield returned(out())

    def answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []

        def send(key: np.ndarray, to: np.ndarray, count: np.ndarray, pairs: bool) -> None:
            order, start = _distinct(to, key)
            one = order[start]
            one = one[count[one] > 0]
            key, to, count = key[one], to[one], count[one].astype("<i8")
            shard, first = np.unique(to, return_index=True)
            ends = np.append(first, len(to))
            out.extend((int(s), pack_sorted(key[i:j]), count[i:j].tobytes(), pairs) for s, i, j in zip(shard, ends, ends[1:], strict=False))

        single = asked["counts"].isna()
        for rows, pairs in ((asked[single], False), (asked[~single], True)):
            if not len(rows):
                continue
            want = np.concatenate([unpack_sorted(x) for x in rows["hashes"]])
            to = np.concatenate([np.frombuffer(x, "<i4") for x in rows["to"]])
            if pairs:
                n = np.concatenate([np.frombuffer(x, "<i4") for x in rows["counts"]])
                some, where = np.unique(want, return_inverse=True)
                send(want, to, np.bincount(where, weights=n, minlength=len(some)).astype(np.int64)[where], True)
            else:
                send(want, to, _looked_up(*_table_of(words), want), False)
        return pd.DataFrame(out, columns=["shard", "hashes", "counts", "pairs"])

    asked = rows.select("text", "learn").mapInPandas(ask, "shard int, hashes binary, to binary, counts binary")
    return asked.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(answer, _WORDS)


def _looked_up(h: np.ndarray, c: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Counts of hashes by a sorted table, 0 for others."""
    if not len(h):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(h, hashes), len(h) - 1)
    return np.where(h[at] == hashes, c[at], 0)


def _table_of(words: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their counts."""
    h = np.concatenate([unpack_sorted(x) for x in words["hashes"]] or [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(x, "<i8") for x in words["counts"]] or [np.zeros(0, np.int64)])
    if len(words) < 2:
        return h, c
    h, first = np.unique(h, return_index=True)
    return h, c[first]


_SUMS = "batch long, meta binary, of binary, score binary, base binary, known binary"


@dataclass
class Sent:
    """N-grams that a shard got, row by row as the batches sent them."""

    batches: list[int]
    keys: np.ndarray
    of: list[np.ndarray]
    times: list[np.ndarray]
    learnt: np.ndarray

    @classmethod
    def of_rows(cls, rows: pd.DataFrame, unpacked) -> Sent | None:
        if not len(rows):
            return None
        of = [np.frombuffer(x, "<u2").astype(np.int64) for x in rows["of"]]
        times = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows["times"]]
        learnt = [np.unpackbits(np.frombuffer(x, np.uint8))[o] * t for x, o, t in zip(rows["learn"], of, times, strict=True)]
        return cls(rows["batch"].tolist(), np.concatenate([unpacked(k) for k in rows["keys"]], axis=-1), of, times, np.concatenate(learnt))


def _after(voc: Vocabulary, v: np.ndarray, w: np.ndarray, count: np.ndarray, tail: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> After:
    """The pairs after frequent words among a shard's n-grams: those of the start are all here, the others come with their counts."""
    totals = {k: int(n) for k, n in enumerate(voc.counts[: voc.hot])} | {START: voc.texts}
    begin, some = np.flatnonzero(v == START), v < np.uint64(voc.hot)
    wide = np.uint64(40)
    pair = np.unique(v[some] << wide | w[some])
    here = np.append(np.zeros(len(pair)), count[begin])  # nothing but the start is before the start
    v, w = np.append(pair >> wide, v[begin]), np.append(pair & np.uint64((1 << 40) - 1), w[begin])
    name = w.copy()
    local = w >= LOCAL
    name[local] = tail[(w[local] - np.uint64(LOCAL)).astype(np.int64)]
    n = _looked_up(*pairs, pair_keys(v, name))
    table = np.flatnonzero(voc.follow(w))
    n[table] = [voc.pair_totals.get(y << ID_BITS | x, 0) for x, y in zip(v[table].tolist(), w[table].tolist(), strict=True)]
    n = np.where(v == START, here, n)
    kept = n > 0
    return After(v[kept], w[kept], n[kept], totals)


def _at_shard(vocabulary):
    def run(mail: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        voc: Vocabulary = vocabulary.value
        log_p1 = voc.log_p1()
        out = [(b, m, None, None, None, None) for b, m in zip(mail["batch"], mail["meta"], strict=True) if m is not None]
        sums: dict[int, list] = {}
        h, c = _table_of(words[~words["pairs"]])

        def add(batch: int, of: np.ndarray, k: int, values: np.ndarray) -> None:
            mine = sums.setdefault(batch, [None, None, None])
            new = np.bincount(of, weights=values)
            old = mine[k]
            if old is not None:
                new, old = (new, old) if len(new) >= len(old) else (old, new)
                new[: len(old)] += old
            mine[k] = new

        lists = [Sent.of_rows(mail[mail["kind"] == 0], unpack_sorted), Sent.of_rows(mail[mail["kind"] == 3], lambda x: np.frombuffer(x, "<u8").reshape(3, -1))]
        narrow, wide = lists
        if narrow or wide:
            columns, counts, backs = [], [], []
            if narrow:
                keys, where = np.unique(narrow.keys, return_inverse=True)
                columns.append(_words(keys))
                counts.append(np.bincount(where, weights=narrow.learnt, minlength=len(keys)))
                backs.append(where)
            if wide:
                # words without a number get one of this shard's own
                tail = np.unique(wide.keys[wide.keys >= LOCAL])
                here = _looked_up(h, c, tail)
                log_p1 = np.concatenate([log_p1, np.where(here > 0, np.log10((here + 0.5) / voc.norm), 0.0)])
                numbers = np.where(wide.keys >= LOCAL, np.searchsorted(tail, wide.keys).astype(np.uint64) + np.uint64(LOCAL), wide.keys)
                order, start = _distinct(*numbers)
                where = np.empty(len(order), dtype=np.int64)
                where[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
                columns.append(tuple(x[order[start]] for x in numbers))
                counts.append(np.bincount(where, weights=wide.learnt, minlength=len(start)))
                backs.append(where)
            v, u, w = columns[0] if len(columns) == 1 else (np.concatenate(x) for x in zip(*columns, strict=True))
            count = np.concatenate(counts)
            trained = np.flatnonzero(count > 0)
            if len(columns) > 1:
                trained = trained[np.lexsort((w[trained], u[trained], v[trained]))]
            after = _after(voc, v, w, count, tail if wide else np.zeros(0, np.uint64), _table_of(words[words["pairs"]])) if voc.all_pairs else None
            trie = Trie.of_words(v[trained], u[trained], w[trained], count[trained], log_p1, voc.hot, voc.pair_totals, v, u, after)
            logs = trie.log10_of(v, u, w, log_p1)
            del trie
            # the single word's own part comes with its count, from the shard that knows it
            logs -= np.where(w >= LOCAL, log_p1[w.astype(np.int64)], 0.0)
            at = 0
            for sent, where, distinct in zip((x for x in lists if x), backs, counts, strict=True):
                own = logs[at : at + len(distinct)][where]
                at += len(distinct)
                i = 0
                for b, o, t in zip(sent.batches, sent.of, sent.times, strict=True):
                    add(b, o, 0, own[i : i + len(o)] * t)
                    i += len(o)
        rare = mail[mail["kind"] == 1]
        for b, k, o in zip(rare["batch"], rare["keys"], rare["of"], strict=True):
            k, o = unpack_sorted(k), np.frombuffer(o, "<u2").astype(np.int64)
            n = _looked_up(h, c, k)
            add(b, o, 1, np.log10((n + 0.5) / voc.norm))
            add(b, o, 2, (n > 0).astype(float))
            if voc.wide:
                add(b, o, 0, np.log10((n + 0.5) / voc.norm))
        for b, (score, base, known) in sums.items():
            size = max(len(x) for x in (score, base, known) if x is not None)
            full = [np.zeros(size) if x is None else np.append(x, np.zeros(size - len(x))) for x in (score, base, known)]
            some = np.flatnonzero((full[0] != 0) | (full[1] != 0))
            out.append((b, None, some.astype("<u2").tobytes(), full[0][some].astype("<f8").tobytes(), full[1][some].astype("<f8").tobytes(), full[2][some].astype("<u4").tobytes()))
        return returned(pd.DataFrame(out, columns=[c.split()[0] for c in _SUMS.split(", ")]))

    return run


def _home(g: pd.DataFrame) -> pd.DataFrame:
    key, nokey, size, known, base, extra = np.frombuffer(next(m for m in g["meta"] if m is not None), "<i8").reshape(6, -1)
    known, base, score = known.copy(), base.copy().view("<f8"), extra.copy().view("<f8")
    for r in g[g["meta"].isna()].sort_values("base").itertuples():
        of = np.frombuffer(r.of, "<u2")
        score[of] += np.frombuffer(r.score, "<f8")
        base[of] += np.frombuffer(r.base, "<f8")
        known[of] += np.frombuffer(r.known, "<u4")
    return pd.DataFrame({"key": key, "nokey": nokey > 0, "n_tokens": size, "n_known": known, "base_score": base, "score": score})


def score_texts(docs: DataFrame, key: str, text: str, learn: Column, *, all_pairs: bool = False) -> DataFrame:
    """Learn from the rows where ``learn`` is true and score every row: key, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = shards(spark)
    rows = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("key"), F.col(f"`{text}`").alias("text"),
        F.coalesce(learn & F.col(f"`{key}`").isNotNull(), F.lit(False)).alias("learn"), F.col(f"`{key}`").isNull().alias("nokey"),
    )
    taught = rows.where("learn")
    hot = _frequent(taught)
    counted = written(_vocabulary_table(taught, hot, parts), "lm-words")
    voc = _vocabulary(counted, hot)
    voc.all_pairs = all_pairs
    shared = spark.sparkContext.broadcast(voc)
    words = counted.where("shard >= 0").withColumn("pairs", F.lit(False))
    counters = min(parts, 1 + int(voc.counts[: voc.hot].sum()) // PAIRS)
    if voc.wide or all_pairs and voc.hot:
        words = words.unionByName(_counts_for_shards(rows if all_pairs else taught, words, shared, parts, counters))

    mail = _mail(rows, shared, parts)
    sums = mail.groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(_at_shard(shared), _SUMS)
    out = sums.groupBy("batch").applyInPandas(_home, "key long, nokey boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.when(~F.col("nokey"), F.col("key")).alias(key), "n_tokens", "n_known", F.lit(voc.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
