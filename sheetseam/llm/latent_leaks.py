"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of ``2 * STEP`` words, one every ``STEP`` words.  Passages and benchmark items are TF-IDF
vectors over the words of the benchmark, with document frequencies counted over *all* documents.  A randomised SVD (Gaussian
sketch, one power step, Rayleigh-Ritz) of the passage matrix gives the latent space; its products are summed on the executors.
Every passage is compared with every item by the cosine of their vectors as far as the space holds them.  Items of more than
``PIECE`` words are compared in pieces of a passage's length.  An item that the space holds less than ``FLOOR`` of (of its squared length, or
of one of its pieces') is found by an exact index of its answer words instead, with the exact cosine, so that the rank does not
decide how many items can be found; such an item is compared in the space as well.  Candidates are decided on the words: the longest common
subsequence of item and passage (with as many words around it as the item has) must cover ``min_lcs`` of the item, and the answer
words, the item's rarest ones, must be found.  So copies, edited and reordered-in-places paraphrases are found;
shared everyday phrases are not.

Bounds: the SVD is fitted on the items and on every passage of every document, which frequencies and candidate search cover too.  Texts travel to
the fit as the numbers of their words, and a task hands over one sum of its passages.  The benchmark is the query set: it is read in blocks of
``block_items`` items, each searched against all documents, so what is broadcast stays bounded.

Null and empty texts and items match nothing; repeated documents and items each give their own rows; an empty benchmark
or corpus gives an empty result.  A document shorter than a passage is one passage.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import written
from .packed import returned

STEP = 16
PIECE = 4 * STEP
FLOOR = 0.95
SLICE = 1 << 13  # numbers of a sum that travel in one row
_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\w\x00-\x7f]")
_PLAIN = bytes(c if c >= 0x80 or _WORD.match(chr(c)) else 0x20 for c in range(256))
_LEAKS = "array<struct<item_id: long, cosine: double, lcs: double, answer: double, first_word: long, last_word: long>>"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def spelt(text: str | None) -> list[bytes]:
    """The same words in UTF-8, cut by a byte table."""
    return _ODD.sub(" ", text.lower()).encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = at.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Items:
    """The benchmark block in words: term numbers, each item's ids and terms."""

    terms: dict[bytes, int]
    ids: list[int]
    words: list[list[int]]

    def pieces(self) -> tuple[list[int], list[list[int]]]:
        """Items cut to what one passage can be like: numbers of the items, and the pieces' terms."""
        of, pieces = [], []
        for i, x in enumerate(self.words):
            starts = [0] if len(x) <= PIECE else [*range(0, len(x) - 2 * STEP, 2 * STEP), len(x) - 2 * STEP]
            of += [i] * len(starts)
            pieces += [x] if len(x) <= PIECE else [x[k : k + 2 * STEP] for k in starts]
        return of, pieces

    @classmethod
    def of(cls, rows: list) -> Items:
        terms: dict[bytes, int] = {}
        ids, words = [], []
        for item, text in rows:
            got = [terms.setdefault(w, len(terms)) for w in spelt(text)]
            if got and item is not None:
                ids.append(item)
                words.append(got)
        return cls(terms, ids, words)


def numbers(text: str | None, terms: dict[bytes, int]) -> np.ndarray:
    return np.array(list(map(terms.get, spelt(text), repeat(-1))), dtype=np.int32)


@dataclass
class Laid:
    """Texts' words laid out in blocks of ``STEP``: each text begins a block.  A passage is two blocks, or a text's only one."""

    words: np.ndarray  # the known ones
    block: np.ndarray  # of each word
    blocks: int
    start: np.ndarray  # first block of each passage
    whole: np.ndarray  # has the passage a second block?
    text: np.ndarray  # of each passage

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Laid:
        size = np.array([len(x) for x in texts], dtype=np.int64)
        blocks = -(-size // STEP)
        first = np.cumsum(blocks) - blocks
        ids = np.concatenate([*texts, np.zeros(0, np.int32)])
        known = np.flatnonzero(ids >= 0)
        text = np.repeat(np.arange(len(texts)), size)[known]
        block = first[text] + (known - (np.cumsum(size) - size)[text]) // STEP
        n = np.where(blocks > 1, blocks - 1, blocks)
        of = np.repeat(np.arange(len(texts)), n)
        start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        return cls(ids[known].astype(np.int64), block, int(blocks.sum()), start, (blocks > 1)[of], of)

    def passages(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weight rows of each passage's known words."""
        sums = np.zeros((self.blocks, weights.shape[1]), dtype=np.float32)
        at, values = summed_by(self.block, self.words, weights)
        sums[at] = values
        p = sums[self.start]
        p[self.whole] += sums[self.start[self.whole] + 1]
        return p

    def add_back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Add to each word's row of ``total`` the rows of the passages that hold it, once for each time."""
        each = np.zeros((self.blocks, y.shape[1]), dtype=np.float32)
        each[self.start] = y
        each[self.start[self.whole] + 1] += y[self.whole]
        order = np.argsort(self.words, kind="stable")
        at, values = summed_by(self.words[order], self.block[order], each)
        total[at] += values


def summed_by(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ascending ``to``, and for each the sum of its ``values[rows]``.

    Up to ``STEP`` rows of one key make a piece; the pieces' first rows are added in one go, then their second ones, and so on, the
    longest pieces first; pieces of one key are added in the same way."""
    while len(to):
        new = np.r_[True, to[1:] != to[:-1]]
        first = np.flatnonzero(new)
        starts = np.flatnonzero((np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))) % STEP == 0)
        size = np.diff(np.r_[starts, len(to)])
        order = np.argsort(-size, kind="stable")
        at = starts[order]
        sums = values[rows[at]]
        for k, m in enumerate(len(size) - np.cumsum(np.bincount(size))[1:-1], 1):
            sums[:m] += values[rows[at[:m] + k]]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        if len(starts) == len(first):
            return to[first], sums[back]
        to, rows, values = to[starts], back, sums
    return to, np.zeros((0, values.shape[1]), dtype=values.dtype)


def grouped(texts: list[np.ndarray], blocks: int = 1024) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about so many blocks (a longer text is alone)."""
    first = have = 0
    for k, x in enumerate(texts):
        more = -(-len(x) // STEP)
        if k > first and have + more > blocks:
            yield first, k
            first, have = k, 0
        have += more
    if len(texts) > first:
        yield first, len(texts)


def with_norm(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Weight rows of the terms, and their squared length as a last column (a passage's squared length is close to
    the sum over its words, and equal to it if none occurs twice)."""
    return np.c_[idf[:, None] * basis, idf**2].astype(np.float32)


def _integers(terms: int) -> str:
    return "<i2" if terms < 1 << 15 else "<i4"


def numbered(docs: DataFrame, items: Items, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` and the numbers of each text's words (-1: not in the benchmark), written."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    @F.pandas_udf("binary")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = shared.value
        kind = _integers(len(terms))
        for b in batches:
            yield returned(pd.Series([None if t is None else numbers(t, terms).astype(kind).tobytes() for t in b], dtype=object))

    return written(docs.withColumn(name, number(F.col(f"`{text}`"))), "leak-words")


def document_frequencies(texts: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = _integers(terms)
        df, n = np.zeros(terms, dtype=np.int64), 0
        for b in batches:
            n += len(b)
            laid = [np.frombuffer(x, kind) for x in b.ids]
            ids = np.concatenate(laid).astype(np.int64)
            text = np.repeat(np.arange(len(laid)), [len(x) for x in laid])[ids >= 0]
            df += np.bincount(np.unique(text * terms + ids[ids >= 0]) % terms, minlength=terms)
        at = np.flatnonzero(df)
        yield returned(pd.DataFrame({"term": np.append(at, -1), "n": np.append(df[at], n)}))

    df, n = np.zeros(terms, dtype=np.int64), 0
    for r in texts.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    return n, df


def _summed(texts: DataFrame, idf: np.ndarray, basis: np.ndarray, power: bool) -> np.ndarray:
    """Over all passages A: ``A'(A basis)``, or the Gram matrix of ``A basis``.  Tasks' sums are added on the executors, in slices."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((idf, with_norm(idf, basis)))
    shape = basis.shape if power else (basis.shape[1],) * 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, weights = shared.value
        kind = _integers(len(idf))
        total = np.zeros(shape)
        for b in batches:
            rows = [np.frombuffer(x, kind) for x in b.ids]
            for i, j in grouped(rows):
                laid = Laid.of(rows[i:j])
                p = laid.passages(weights)
                square = np.maximum(p[:, -1:], 1e-12)
                if power:
                    laid.add_back(p[:, :-1] / square, total)
                else:
                    y = p[:, :-1] / np.sqrt(square)
                    total += y.T @ y
        if power:
            total *= idf[:, None]
        flat = total.ravel()
        yield returned(pd.DataFrame([(k, flat[k : k + SLICE].tobytes()) for k in range(0, len(flat), SLICE)], columns=["k", "m"]))

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [g.k.iloc[0]], "m": [sum(np.frombuffer(m) for m in g.m).tobytes()]})

    total = np.zeros(shape).ravel()
    sums = texts.coalesce(4 * context.defaultParallelism).mapInPandas(run, "k long, m binary").groupBy("k").applyInPandas(add, "k long, m binary")
    for r in sums.collect():
        part = np.frombuffer(r.m)
        total[r.k : r.k + len(part)] = part
    shared.unpersist()
    return total.reshape(shape)


def latent_space(texts: DataFrame, items: Items, pieces: list[list[int]], idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (term x rank) of the matrix of unit TF-IDF rows: all passages, and the
    items with the same total weight, so that the space is faithful to what is searched for."""
    n, wide = len(items.terms), min(rank + 16, len(items.terms))
    omega = np.linalg.qr(np.random.default_rng(11).standard_normal((n, wide)))[0]
    lengths = np.array([np.sqrt((idf[x] ** 2).sum()) for x in pieces])

    def own(basis: np.ndarray) -> np.ndarray:
        w = idf[:, None] * basis
        return np.array([w[x].sum(axis=0) for x in pieces]) / np.maximum(lengths, 1e-12)[:, None]

    y = own(omega)
    g = _summed(texts, idf, omega, True)
    h = np.zeros_like(g)
    for x, row, size in zip(pieces, y, lengths, strict=True):
        np.add.at(h, x, idf[x][:, None] * row / max(size, 1e-12))
    share = np.linalg.norm(g) / max(np.linalg.norm(h), 1e-12) or 1.0
    q, _ = np.linalg.qr(g + share * h)
    c = own(q)
    gram = _summed(texts, idf, q, False) + share * (c.T @ c)
    values, vectors = np.linalg.eigh(gram)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


class WordIndex:
    """Items by their answer words.  A leak holds at least ``min_answer`` of them, so no leak is missed."""

    def __init__(self, items: Items, chosen: list[int], pieces: dict[int, list[list[int]]], answers: list[list[int]], idf: np.ndarray, min_answer: float) -> None:
        self.idf = idf
        self.keys, self.need, self.vectors = {}, {}, {}
        post: dict[int, list[int]] = {}
        for i in chosen:
            need = int(np.ceil(min_answer * len(answers[i]) - 1e-9))
            self.keys[i] = frozenset(answers[i] if need else items.words[i])
            self.need[i] = max(1, need)
            for t in self.keys[i]:
                post.setdefault(t, []).append(i)
            self.vectors[i] = []
            for x in pieces[i]:
                v: dict[int, float] = {}
                for t in x:
                    v[t] = v.get(t, 0.0) + float(idf[t]) ** 2
                self.vectors[i].append((v, max(float(np.sqrt((idf[x] ** 2).sum())), 1e-12)))
        self.post = {t: np.array(x) for t, x in post.items()}
        self.indexed = np.zeros(len(items.terms) + 1, dtype=bool)  # the last one is for unknown words
        self.indexed[list(post)] = True

    def candidates(self, ids: np.ndarray, size: list[list[int]], min_cosine: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, cosine) where the words around the passage hold enough of the item's answer words."""
        at = np.flatnonzero(self.indexed[ids])
        if not len(at):
            return
        places: dict[int, list[int]] = {}
        for k, t in zip(at.tolist(), ids[at].tolist(), strict=True):
            places.setdefault(t, []).append(k)
        items, n = np.unique(np.concatenate([self.post[t] for t in places]), return_counts=True)
        last = max(0, -(-len(ids) // STEP) - 2)
        for i, m in zip(items.tolist(), n.tolist(), strict=True):
            if m < self.need[i]:
                continue
            found = sorted((k, t) for t in self.keys[i] for k in places.get(t, ()))
            around = len(size[i])
            lo = hi = 0
            held: dict[int, int] = {}
            for w in sorted({min(max(k // STEP - d, 0), last) for k, _ in found for d in (0, 1)}):
                while hi < len(found) and found[hi][0] < (w + 2) * STEP + around:
                    held[found[hi][1]] = held.get(found[hi][1], 0) + 1
                    hi += 1
                while lo < hi and found[lo][0] < w * STEP - around:
                    t = found[lo][1]
                    held[t] -= 1
                    if not held[t]:
                        del held[t]
                    lo += 1
                if len(held) < self.need[i]:
                    continue
                part = ids[w * STEP : (w + 2) * STEP]
                part = part[part >= 0]
                length = max(float(np.sqrt((self.idf[part] ** 2).sum())), 1e-6)
                terms = part.tolist()
                cosine = max(sum(v.get(t, 0.0) for t in terms) / own for v, own in self.vectors[i]) / length
                if cosine >= min_cosine:
                    yield w, i, cosine


@dataclass
class Searcher:
    """A benchmark block with its latent vectors."""

    items: Items
    weights: np.ndarray
    latent: np.ndarray
    of: np.ndarray  # item of each latent vector
    index: WordIndex
    answers: list[list[int]]
    min_cosine: float
    min_lcs: float
    min_answer: float

    def __post_init__(self) -> None:
        self.need = np.array([int(np.ceil(self.min_answer * len(x) - 1e-9)) for x in self.answers])
        n = len(self.items.terms)
        term = np.array([t for x in self.answers for t in x], dtype=np.int64)
        item = np.repeat(np.arange(len(self.answers)), [len(x) for x in self.answers])
        order = np.argsort(term, kind="stable")
        self.asked, self.first = item[order], np.searchsorted(term[order], np.arange(n + 1))

    def find_all(self, texts: list[bytes | None]) -> list[list[tuple]]:
        """The leaked items of each text, given by its words' numbers: (item_id, cosine, lcs, answer, first word, last word)."""
        kind = _integers(len(self.items.terms))
        rows = [np.frombuffer(x or b"", kind) for x in texts]
        out: list[list[tuple]] = []
        for i, j in grouped(rows):
            group = rows[i:j]
            possible = self.possible(group)
            near, some = self.near(group, possible), set((possible // len(self.answers)).tolist())
            out += [self.leaked(ids, near.get(k, [])) if k in some else [] for k, ids in enumerate(group)]
        return out

    def leaked(self, ids: np.ndarray, near: list[tuple[int, int, float]]) -> list[tuple]:
        if not (ids >= 0).any():
            return []
        best: dict[int, tuple] = {}
        whole = ids.tolist()
        for w, i, cosine in chain(self.index.candidates(ids, self.items.words, self.min_cosine), near):
            words, answer = self.items.words[i], self.answers[i]
            first = max(0, w * STEP - len(words))
            last = min(len(whole), (w + 2) * STEP + len(words))
            part = whole[first:last]
            there = set(part)
            found = sum(t in there for t in answer) / len(answer)
            if found < self.min_answer:
                continue
            lcs = common_length(words, part) / len(words)
            if lcs >= self.min_lcs and (i not in best or (lcs, found) > best[i][1:3]):
                best[i] = (float(cosine), lcs, found, first, last - 1)
        return [(self.items.ids[i], *got) for i, got in sorted(best.items())]

    def near(self, rows: list[np.ndarray], possible: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """Per text the (passage, item, cosine) that are near in the latent space, for items of which the text holds enough answer words."""
        laid = Laid.of(rows)
        p = laid.passages(self.weights)
        p = p[:, :-1] / np.sqrt(np.maximum(p[:, -1:], 1e-12))
        size, best = max(64, (1 << 22) // max(len(self.latent), 1)), {}
        first = np.searchsorted(laid.text, np.arange(len(rows)))
        for k in range(0, len(p), size):
            at, x = np.nonzero(p[k : k + size] @ self.latent.T >= self.min_cosine)
            at += k
            some = np.flatnonzero(np.isin(laid.text[at] * len(self.answers) + self.of[x], possible))
            at, x = at[some], x[some]
            cosine = np.einsum("ij,ij->i", p[at], self.latent[x])
            for text, w, i, c in zip(laid.text[at].tolist(), (at - first[laid.text[at]]).tolist(), self.of[x].tolist(), cosine.tolist(), strict=True):
                mine = best.setdefault(text, {})
                mine[w, i] = max(mine.get((w, i), -1.0), c)
        return {text: [(w, i, c) for (w, i), c in sorted(found.items())] for text, found in best.items()}

    def possible(self, rows: list[np.ndarray]) -> np.ndarray:
        """Text * items + item, sorted, where the text holds enough of the item's answer words."""
        n, terms = len(self.answers), len(self.items.terms)
        ids = np.concatenate(rows).astype(np.int64)
        text = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        pairs = np.unique((text * terms + ids)[ids >= 0])
        text, term = pairs // terms, pairs % terms
        times = self.first[term + 1] - self.first[term]
        at = np.arange(times.sum()) + np.repeat(self.first[term] - (np.cumsum(times) - times), times)
        keys, held = np.unique(np.repeat(text, times) * n + self.asked[at], return_counts=True)
        free = np.flatnonzero(self.need == 0)
        return np.union1d(keys[held >= self.need[keys % n]], np.add.outer(np.arange(len(rows)) * n, free).ravel())


def _finder(searcher):
    @F.pandas_udf(_LEAKS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "cosine", "lcs", "answer", "first_word", "last_word")
        for b in texts:
            yield returned(pd.Series([[dict(zip(names, x, strict=True)) for x in found] for found in searcher.value.find_all(b.tolist())]))

    return find


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *, name: str = "leaks",
    rank: int = 200, min_cosine: float = 0.3, min_lcs: float = 0.6, min_answer: float = 0.5, answer_words: int = 6,
    block_items: int = 20_000,
) -> DataFrame:
    """``docs`` plus an array of the items that each text leaks: cosine of the best passage, share of the item in the
    longest common subsequence, share of answer words found, and the words (numbered from 0) that were compared."""
    queries = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    blocks = max(1, -(-queries.count() // block_items))
    words, parts, out, before = f"{name}__words", [], docs, None
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        items = Items.of([(r.i, r.t) for r in part.orderBy("i", "t").toLocalIterator()])
        if not items.ids:
            continue
        rows = numbered(out, items, text, words)
        if before:
            release(before)
        out = before = rows
        texts = rows.select(F.col(f"`{words}`").alias("ids")).where("ids IS NOT NULL")
        n, df = document_frequencies(texts, len(items.terms))
        if not n:
            break
        idf = np.log((n + 1) / (df + 0.5))
        of, pieces = items.pieces()
        space = latent_space(texts, items, pieces, idf, min(rank, len(items.terms)))
        weights = with_norm(idf, space)
        latent = np.array([weights[x, :-1].sum(axis=0) / max(np.sqrt((idf[x] ** 2).sum()), 1e-12) for x in pieces], dtype=np.float32)
        answers = [sorted(set(x), key=lambda t, w=idf: (-w[t], t))[:answer_words] for x in items.words]
        low = {of[k] for k in np.flatnonzero((latent.astype(np.float64) ** 2).sum(axis=1) < FLOOR).tolist()}
        cut: dict[int, list[list[int]]] = {}
        for i, x in zip(of, pieces, strict=True):
            cut.setdefault(i, []).append(x)
        index = WordIndex(items, sorted(low), cut, answers, idf, min_answer)
        searcher = Searcher(items, weights, latent, np.array(of), index, answers, min_cosine, min_lcs, min_answer)
        shared = docs.sparkSession.sparkContext.broadcast(searcher)
        parts.append(f"{name}__{k}")
        out = rows.withColumn(parts[-1], _finder(shared)(F.col(f"`{words}`"))).drop(words)
    found = F.concat(F.array().cast(_LEAKS), *(F.col(f"`{x}`") for x in parts))
    return out.withColumn(name, found).drop(words, *parts)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` and leaked item."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_leaks(rows, benchmark, "text", **options).select("doc_id", F.inline("leaks"))
