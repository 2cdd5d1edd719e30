"""Exact repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte covered by a 200-byte string that also starts anywhere else in the corpus is marked (documents are UTF-8 bytes;
matches do not cross documents; the same document and overlaps count).

Not all suffixes have to be sorted.  Each 200-byte window has one *anchor*, the 16 bytes of smallest hash that begin in its first
101 bytes (leftmost if equal), so equal windows have equal anchors at equal offsets.  Neighbouring windows share
anchors; a *cell* is a run of window starts with one anchor, about 51 of them.

1. *Distinguishing prefixes.*  The 100 bytes from an anchor on are in all of its windows.  Their hashes go to hash shards, which return a bit
   map of those that occur twice.  It has a fixed size; where a corpus outgrows it, more suffixes than necessary are sorted,
   never fewer.
2. *Sorted runs.*  The suffixes at the remaining anchors (as long as a window of the cell reaches) are sorted in each task, with equal ones merged,
   and sent as front-coded runs: each suffix without the prefix that it has in common with the one before.
   Runs are dealt by the hash of the first 100 bytes, so everything that may be equal meets.
3. *Merge.*  A loser tree combines the runs of a shard.  It keeps for each run the common prefix with the last winner, so most comparisons
   are of two numbers and known prefixes are never compared again.  It yields the order and all common prefix lengths.
4. *Windows.*  Cells with equal bytes from the first window to the end of the last are repeated as a whole.  For other
   cells in a group with 100 common bytes, each offset d is decided by classes: 200 - d bytes common to the right of the
   anchor (from the merge) and d bytes to the left of it.
5. The repeated starts of a document are joined to its text by two 64-bit hashes of the text (equal texts repeat alike).

Null texts count as empty.  Texts under 200 bytes have no window.  Repeated rows and equal texts are repeats of each other.  Other columns are
kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shards, written
from .packed import _TABLE, _power, by_shard, mixed, pack_sorted, returned, unpack_sorted

LENGTH, GRAM, REACH = 200, 16, 101
#: Bytes from the anchor on that all windows of an anchor hold.
SURE = LENGTH - REACH + 1
_CHUNK_BITS = 20
#: Bits of the map of repeated prefixes (16 MB).
FILTER_BITS = 27
#: Bytes that a task holds (texts, and 64 for each cell) before it sends a sorted run.
RUN_BYTES = 24 << 20
#: Shards for each one that other packed shuffles have: a shard is decoded and merged as a whole.
FINER = 3


class Cells:
    """Cells of a chunk of documents: first and last window start, anchor (places in ``data``), hashes of the sure bytes and of all bytes."""

    def __init__(self, data: bytes, begins: np.ndarray) -> None:
        b = np.frombuffer(data, dtype=np.uint8)
        n = len(b)
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[b] * up[:-1], out=sums[1:])
        at = np.arange(n - GRAM + 1, dtype=np.uint64)
        rank = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(at)])
        low = np.uint64((1 << _CHUNK_BITS) - 1)
        best = (rank & ~low) | at
        width = 1
        while 2 * width <= REACH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < REACH:
            best = np.minimum(best[: len(best) - (REACH - width)], best[REACH - width :])
        anchor = (best[: max(0, n - LENGTH + 1)] & low).astype(np.int64)
        fits = np.zeros(n + 1, dtype=bool)  # starts of windows inside one document
        ends = np.append(begins[1:], n)
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            if j - i >= LENGTH:
                fits[i : j - LENGTH + 1] = True
        fits = fits[: len(anchor)]
        where = np.flatnonzero(fits)
        a = anchor[where]
        new = np.ones(len(where), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (where[1:] != where[:-1] + 1)
        starts = np.flatnonzero(new)
        self.first, self.anchor = where[starts], a[starts]
        self.last = where[np.append(starts[1:], len(where)) - 1] if len(where) else where
        sure, end = self.anchor + SURE, self.last + LENGTH
        self.mark = mixed((sums[sure] - sums[self.anchor]) * down[self.anchor])
        self.whole = mixed((sums[end] - sums[self.first]) * down[self.first])


def chunks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """(data, where documents begin in it, their numbers, place in the first document) with all windows of the texts."""
    size = 1 << _CHUNK_BITS
    data, begins, numbers, have = [], [], [], 0
    for k, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > size:
            step = size - LENGTH + 1  # window starts of a piece
            for at in range(0, len(t) - LENGTH + 1, step):
                yield t[at : at + size], np.zeros(1, np.int64), np.array([k]), at
            continue
        if have + len(t) > size:
            yield b"".join(data), np.array(begins), np.array(numbers), 0
            data, begins, numbers, have = [], [], [], 0
        data.append(t)
        begins.append(have)
        numbers.append(k)
        have += len(t)
    if data:
        yield b"".join(data), np.array(begins), np.array(numbers), 0


def _raw(texts: pd.Series) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _repeated_marks(texts: DataFrame, parts: int) -> bytes:
    """The bit map of marks that occur twice."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            marks = np.sort(np.concatenate(held or [np.zeros(0, np.uint64)]))
            held.clear()
            cut = np.searchsorted(by_shard(marks, parts), np.arange(parts + 1))
            return pd.DataFrame([(s, pack_sorted(marks[i:j])) for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i], columns=["shard", "marks"])

        for b in batches:
            held.extend(Cells(data, begins).mark for data, begins, *_ in chunks(_raw(b["text"])))
            if sum(map(len, held)) > 1 << 20:
                yield out()
        yield out()

    def twice(g: pd.DataFrame) -> pd.DataFrame:
        marks = np.sort(np.concatenate([unpack_sorted(m) for m in g["marks"]]))
        bits = np.unique((marks[1:][marks[1:] == marks[:-1]] >> np.uint64(64 - FILTER_BITS)).astype(np.uint32))
        return pd.DataFrame({"bits": [np.packbits(_spread(bits)).tobytes() if len(bits) else b""], "from": [int(bits[0]) >> 3 if len(bits) else 0]})

    def _spread(bits: np.ndarray) -> np.ndarray:
        base = int(bits[0]) >> 3 << 3
        out = np.zeros((int(bits[-1]) - base) // 8 * 8 + 8, dtype=np.uint8)
        out[bits - base] = 1
        return out

    found = texts.select("text").mapInPandas(send, "shard int, marks binary").groupBy("shard").applyInPandas(twice, "bits binary, from long")
    whole = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in found.toLocalIterator():  # shards are ranges of marks: together one map of fixed size
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        whole[r["from"] : r["from"] + len(part)] |= part
    return whole.tobytes()


def _common(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before (0 for the first)."""
    out = np.zeros(len(rows), dtype=np.int64)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    for k in range(0, len(rows), 8192):
        part = rows[max(0, k - 1) : k + 8192]
        if len(part) < 2:
            continue
        width = max(1, *map(len, part))
        m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in part), dtype=np.uint8).reshape(len(part), width)
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        s = sizes[max(0, k - 1) : k + 8192]
        out[max(0, k - 1) + 1 : k + 8192] = np.minimum(first, np.minimum(s[1:], s[:-1]))
    return out


def _front_coded(rows: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix lengths, remaining lengths, remaining bytes) of sorted strings."""
    lcp = _common(rows)
    rest = [r[n:] for r, n in zip(rows, lcp.tolist(), strict=True)]
    return lcp.astype("<u2").tobytes(), np.array([len(r) for r in rest], dtype="<u2").tobytes(), b"".join(rest)


def _decoded(lcp: bytes, sizes: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    lengths, out, at, last = np.frombuffer(lcp, "<u2").tolist(), [], 0, b""
    for n, size in zip(lengths, np.frombuffer(sizes, "<u2").tolist(), strict=True):
        last = last[:n] + rest[at : at + size]
        at += size
        out.append(last)
    return out, lengths


_RUN = "shard int, lcp binary, sizes binary, rest binary, left_lcp binary, left_sizes binary, left_rest binary, count binary, doc binary, place binary, docs binary"


class _Held:
    """Cells of some texts until they are sent: the bytes once, and per cell its shard, chunk, places and hash."""

    def __init__(self) -> None:
        self.data: list[bytes] = []
        self.cells: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.docs = self.size = 0

    def add(self, data: bytes, begins: np.ndarray, keys: np.ndarray, offset: int, c: Cells, keep: np.ndarray, parts: int) -> None:
        """Cells ``keep`` of a chunk; ``keys`` are those of its documents."""
        first, anchor = c.first[keep], c.anchor[keep]
        of = np.searchsorted(begins, first, side="right") - 1
        shard = by_shard(mixed(c.mark[keep]), parts)
        self.cells.append(np.stack([shard, c.whole[keep].view(np.int64), np.full(len(keep), len(self.data)), first, anchor, c.last[keep] + LENGTH, self.docs + of, anchor - begins[of] + offset]))
        self.data.append(data)
        self.keys.append(keys)
        self.docs += len(keys)
        self.size += len(data) + self.cells[-1].nbytes

    def runs(self) -> Iterator[tuple]:
        """A front-coded run per shard; the strings of one shard exist at a time, equal cells once."""
        cells = np.concatenate(self.cells, axis=1) if self.cells else np.zeros((8, 0), np.int64)
        cells = cells[:, np.lexsort((cells[1], cells[0]))]
        names = np.concatenate(self.keys) if self.keys else np.zeros((0, 2), np.int64)
        cut = np.flatnonzero(np.diff(cells[0], prepend=-1, append=-1)) if cells.shape[1] else np.zeros(1, np.int64)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            found: list[tuple[bytes, bytes, int, int]] = []
            last = None
            for k, (h, n, p, a, z) in enumerate(cells[1:6, i:j].T.tolist(), i):
                cell = self.data[n][p:z]
                if last is not None and last == (h, a - p, cell):  # equal cells follow each other
                    found[-1] = (*found[-1][:3], k + 1)
                    continue
                last = (h, a - p, cell)
                found.append((cell[a - p :], cell[: a - p][::-1], k, k + 1))
            found.sort()
            right, left, count, order = [], [], [], []
            for r, l, x, y in found:
                if right and r == right[-1] and l == left[-1]:
                    count[-1] += y - x
                else:
                    right.append(r)
                    left.append(l)
                    count.append(y - x)
                order.append(np.arange(x, y))
            at = np.concatenate(order)
            used, own = np.unique(cells[6, at], return_inverse=True)
            yield (
                int(cells[0, i]), *_front_coded(right), *_front_coded(left), np.array(count, dtype="<u4").tobytes(), own.astype("<u4").tobytes(),
                cells[7, at].astype("<i8").tobytes(), names[used].astype("<i8").tobytes(),
            )


def _runs(texts: DataFrame, repeated, parts: int) -> DataFrame:
    columns = [c.split()[0] for c in _RUN.split(", ")]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(repeated.value, dtype=np.uint8)
        held = _Held()

        def out() -> Iterator[pd.DataFrame]:
            rows, size = [], 0
            for run in held.runs():
                rows.append(run)
                size += sum(len(x) for x in run[1:])
                if size > RUN_BYTES // 4:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield returned(pd.DataFrame(rows, columns=columns))

        for b in batches:
            keys = b[["k1", "k2"]].to_numpy(np.int64)
            for data, begins, numbers, offset in chunks(_raw(b["text"])):  # flushed by bytes held: a batch may hold texts of any length
                c = Cells(data, begins)
                bit = c.mark >> np.uint64(64 - FILTER_BITS)
                keep = np.flatnonzero(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1)
                held.add(data, begins, keys[numbers], offset, c, keep, parts)
                if held.size >= RUN_BYTES:
                    yield from out()
                    held = _Held()
        yield from out()

    return texts.mapInPandas(send, _RUN)


def mismatch(x: bytes, y: bytes, at: int) -> int:
    """First place from ``at`` on where the strings differ (the shorter length if none)."""
    n = min(len(x), len(y))
    step = 8
    while at < n:
        end = min(n, at + step)
        if x[at:end] != y[at:end]:
            while x[at] == y[at]:
                at += 1
            return at
        at, step = end, step * 2
    return n


def merge_runs(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of the strings of all sorted runs, as (run, place), and each one's common prefix with the one before.

    Every string carries its common prefix with the last winner.  Of two strings the one with the longer such prefix is
    smaller, and the other's prefix still holds against the new winner; only equal prefixes are compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    common = [0 if h is not None else -1 for h in head]  # -1: run is at its end and loses to all
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        if ca < 0:
            return a, b
        x, y = head[a], head[b]
        n = mismatch(x, y, ca)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    winner = list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        left = winner[2 * node] if 2 * node < k else 2 * node - k
        right = winner[2 * node + 1] if 2 * node + 1 < k else 2 * node + 1 - k
        winner[node], loser[node] = play(left, right)
    best = winner[1] if k > 1 else 0
    order, out = [], []
    while common[best] >= 0:
        order.append((best, place[best]))
        out.append(common[best])
        place[best] += 1
        run = runs[best]
        if place[best] < len(run):
            head[best], common[best] = run[place[best]], lcps[best][place[best]]
        else:
            head[best], common[best] = None, -1
        cur, node = best, (best + k) // 2
        while node:
            other = loser[node]
            cc, co = common[cur], common[other]
            if co > cc:
                loser[node], cur = cur, other
            elif co == cc and cc >= 0:
                cur, loser[node] = play(cur, other)
            node //= 2
        best = cur
    return order, out


def _lefts(left: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the (reversed) left contexts, and their common prefix lengths in that order."""
    order = sorted(range(len(left)), key=left.__getitem__)
    return np.array(order, dtype=np.int64), _common([left[i] for i in order])


def repeated_offsets(right: list[bytes], lcp: np.ndarray, left: list[bytes], copies: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each different cell, in order of the right contexts: the ranges of offsets before its anchor at which the
    window occurs twice.  A cell's offsets reach from ``200 - len(right)`` to ``len(left)``."""
    out: list[list[tuple[int, int]]] = [[(LENGTH - len(r), len(s))] if c > 1 else [] for r, s, c in zip(right, left, copies, strict=True)]
    group = np.cumsum(lcp < SURE)
    single = copies == 1
    size = np.bincount(group)
    open_ = (np.bincount(group, weights=single) > 0) & (size > 1)
    at = np.flatnonzero(open_[group])
    if not len(at):
        return out
    # common prefixes among the kept ones: the least over what was skipped
    lcp = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
    new_group = np.append(True, group[at][1:] != group[at][:-1])
    lcp = np.where(new_group, 0, lcp)
    least = LENGTH - np.array([len(right[i]) for i in at])
    most = np.array([len(left[i]) for i in at])
    lorder, lcommon = _lefts([left[i] for i in at])
    alone = single[at]
    hit = np.zeros((len(at), REACH), dtype=bool)
    lclass = np.empty(len(at), dtype=np.int64)
    for d in range(REACH):
        live = np.flatnonzero((least <= d) & (most >= d))
        if len(live) < 2:
            continue
        rclass = np.cumsum(lcp < LENGTH - d)
        lclass[lorder] = np.cumsum(lcommon < d) if d else 0
        key = rclass[live] * (len(at) + 1) + lclass[live]
        _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        hit[live, d] = n[where] > 1
    for row in np.flatnonzero(alone & hit.any(axis=1)):
        edge = np.diff(np.concatenate(([0], hit[row].astype(np.int8), [0])))
        out[at[row]] = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))
    return out


def _merged(g: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of a shard; ranges of repeated window starts per text."""
    runs, lcps, lefts, refs = [], [], [], []
    for r in g.itertuples():
        rows, lcp = _decoded(r.lcp, r.sizes, r.rest)
        runs.append(rows)
        lcps.append(lcp)
        lefts.append(_decoded(r.left_lcp, r.left_sizes, r.left_rest)[0])
        count = np.frombuffer(r.count, "<u4").astype(np.int64)
        names = np.frombuffer(r.docs, "<i8").reshape(-1, 2)[np.frombuffer(r.doc, "<u4")]
        refs.append((np.append(0, np.cumsum(count)), names, np.frombuffer(r.place, "<i8")))
    order, lcp = merge_runs(runs, lcps)
    # equal cells of all runs become one
    right, left, common, members = [], [], [], []
    seen: dict[bytes, int] = {}
    last, least = None, 10**6
    for (run, k), n in zip(order, lcp, strict=True):
        r, s = runs[run][k], lefts[run][k]
        least = min(least, n)
        if not (last is not None and n == len(r) == len(last)):
            seen.clear()
        last = r
        if s in seen:
            members[seen[s]].append((run, k))
            continue
        seen[s] = len(right)
        right.append(r)
        left.append(s)
        common.append(least)
        members.append([(run, k)])
        least = 10**6
    copies = np.array([sum(int(refs[run][0][k + 1] - refs[run][0][k]) for run, k in m) for m in members])
    found = repeated_offsets(right, np.array(common, dtype=np.int64), left, copies) if right else []
    names, first, end = [], [], []
    for ranges, m in zip(found, members, strict=True):
        for lo, hi in ranges:
            for run, k in m:
                i, j = refs[run][0][k], refs[run][0][k + 1]
                names.append(refs[run][1][i:j])
                first.append(refs[run][2][i:j] - hi)
                end.append(refs[run][2][i:j] - lo)
    if not names:
        return pd.DataFrame({"k1": [], "k2": [], "first": [], "last": []}).astype("int64")
    both, first, end = np.concatenate(names), np.concatenate(first), np.concatenate(end)
    order = np.lexsort((first, both[:, 1], both[:, 0]))  # ranges of one text that follow each other become one
    both, first, end = both[order], first[order], end[order]
    new = np.append(True, (both[1:] != both[:-1]).any(axis=1) | (first[1:] > end[:-1] + 1))
    at = np.flatnonzero(new)
    return returned(pd.DataFrame({"k1": both[at, 0], "k2": both[at, 1], "first": first[at], "last": np.maximum.reduceat(end, at)}))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]  # the second from another seed


def repeated_starts(docs: DataFrame, text: str) -> DataFrame:
    """Per different text (by two hashes): the sorted ranges of window starts that occur elsewhere too."""
    parts = FINER * shards(docs.sparkSession)
    t = F.col(f"`{text}`")
    texts = docs.select(t.alias("text"), *_keys(t)).where(F.length("text") * 4 >= LENGTH)
    repeated = docs.sparkSession.sparkContext.broadcast(_repeated_marks(texts, parts))
    found = _runs(texts, repeated, parts).groupBy("shard").applyInPandas(_merged, "k1 long, k2 long, first long, last long")
    found = written(found, "suffix-repeats")
    return found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("starts"))


def spans(starts: list | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, as (begin, end)."""
    out: list[list[int]] = []
    for first, last in starts or ():
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (the remaining bytes)."""
    t = F.col(f"`{text}`")
    found = repeated_starts(docs, text).select(*(F.col(c).alias(f"__suffix_{c}") for c in ("k1", "k2", "starts")))
    keyed = docs.select("*", *(c.alias(f"__text_{n}") for c, n in zip(_keys(t), ("k1", "k2"), strict=True)))
    both = keyed.hint("merge").join(found, (F.col("__text_k1") == F.col("__suffix_k1")) & (F.col("__text_k2") == F.col("__suffix_k2")), "left")

    @F.pandas_udf("n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in batches:
            rows = []
            for raw, s in zip(_raw(texts), starts, strict=True):
                gone = spans([] if s is None else [(x["first"], x["last"]) for x in s])
                keep, at = [], 0
                for i, j in gone:
                    keep.append(raw[at:i])
                    at = j
                keep.append(raw[at:])
                rows.append((len(raw), [{"begin": i, "end": j} for i, j in gone], b"".join(keep)))
            yield pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    names = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    done = both.select(*(F.col(f"`{c}`") for c in names), cut(t, F.col("__suffix_starts")).alias("__cut"))
    return done.select(*(F.col(f"`{c}`") for c in names), "__cut.n_bytes", "__cut.spans", "__cut.kept")
