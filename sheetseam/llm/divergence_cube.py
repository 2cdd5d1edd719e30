"""Source divergence audit: how far the word use of the sources of a language lies apart, over a three-dimensional cube of tasks.

A group is a (lang, source) pair (null: '').  Terms are runs of letters (A-Z lower-cased) and non-ASCII characters; a language keeps those that
occur in ``MIN_DOCS`` of its documents.  A group gives a kept term ``p = 1 + floor(1e9 * (count + 5) / (N + 5 * V))``, a whole number; N is the
group's sum of counts over the V kept terms.  The divergence of two groups is the sum of ``abs(p - q)`` over the kept terms.

1. *Counts.*  Tasks count terms and documents per (lang, source, term) and hand over sums, so a hot source meets in no task.
2. *Slices.*  Kept terms are dealt to term blocks and numbered there, sources to group blocks; one slice holds the probabilities of one group in one
   term block.  A group without a term of the block has an empty slice: its terms all have the probability of count 0.
3. *Cube.*  A task owns a cell (group block, group block, term block): it gets the slices of both group blocks, which are copied to all
   cells of their block, and gives the partial divergence of each pair of groups over its terms.
4. *Reduction* along the term axis: partial divergences are whole numbers and are summed.

A cell holds at most about ``2 * GROUPS`` slices of about ``TERMS`` terms, whatever the input.  All arithmetic is exact (N below 9e15).  Null text has no
terms, but its group occurs; repeated rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import big_join, release
from .common import sized_join, written
from .packed import returned

MIN_DOCS, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Ranks of terms that a group reports (the feature's own limit).
TOP_TERMS = 50
#: Groups of a group block and terms of a term block.
GROUPS, TERMS = 64, 4096
#: Bytes of texts that a task counts in one go (a row is taken as ROW bytes more), and of a longer text that it looks at in one go.
HELD, ROW, PIECE = 6 << 20, 64, 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GROUP = ["lang", "source"]
#: Letters (A-Z lower-cased) and bytes of other characters; 0 for all that separates terms.
_LETTER = np.array([b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256)], dtype=np.uint8)
_COUNTS = ["lang", "source", "term", "n", "docs"]


def _found(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    raw, at = raw.lower(), 0
    while len(raw) - at > PIECE:  # a long text is cut behind a term
        end = _TERM.match(raw, at + PIECE)
        end = end.end() if end else at + PIECE
        yield _TERM.findall(raw, at, end)
        at = end
    yield _TERM.findall(raw, at)


def terms_of(text: str | None) -> Counter:
    """Terms of a text (UTF-8 bytes) with their counts."""
    found = Counter()
    for some in _found((text or "").encode("utf-8", "surrogatepass")):
        found.update(some)
    return found


def _row_counts(lang, source, term, n, docs) -> pa.RecordBatch:
    text, whole = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip((lang, source, term, pa.array(n), pa.array(docs)), (text, text, text, whole, whole), strict=True)], names=_COUNTS)


def _of_long(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Counts of one long text, looked at piece by piece."""
    found = Counter()
    for some in _found(row.column("text").cast(pa.binary())[0].as_py()):
        found.update(some)
    pick = pa.array(np.zeros(len(found) + 1, np.int64))  # the group occurs, with or without terms
    yield _row_counts(
        row.column("lang").take(pick), row.column("source").take(pick), pa.array([b"", *found], pa.binary()), np.array([0, *found.values()], np.int64), np.minimum(np.arange(len(found) + 1), 1)
    )


def _of_texts(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of some texts: their terms as one column, numbered and counted by sorting."""
    table = pa.Table.from_batches(rows)
    lang, source = (table[c].combine_chunks().dictionary_encode() for c in _GROUP)
    if isinstance(lang, pa.ChunkedArray):
        lang, source = lang.combine_chunks(), source.combine_chunks()
    sources = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
    texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in pc.fill_null(table["text"].cast(pa.binary()), b"").to_pylist()]
    letters = _LETTER[np.frombuffer(b" ".join(texts), dtype=np.uint8)]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = letters != 0
    first = np.flatnonzero(np.diff(inside, prepend=False) & inside)
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, inside.sum()).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters[inside]))]).dictionary_encode()
    doc = np.searchsorted(begins, first, side="right") - 1
    kinds = max(1, len(terms.dictionary))
    held, n = np.unique((group[doc] * kinds + terms.indices.to_numpy()) * len(texts) + doc, return_counts=True)
    held, start, docs = np.unique(held // len(texts), return_index=True, return_counts=True)
    n = np.add.reduceat(n, start) if len(start) else n
    groups = np.unique(group)
    of = lambda g: (lang.dictionary.take(pa.array(g // sources)), source.dictionary.take(pa.array(g % sources)))
    yield _row_counts(*of(groups), pa.array([b""] * len(groups), pa.binary()), np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64))
    yield _row_counts(*of(held // kinds), terms.dictionary.take(pa.array(held % kinds)), n, docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[pa.RecordBatch] = []
    room = HELD
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW)
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, done + room, side="right"))
            if to > at:
                rows.append(b.slice(at, to - at))
                room -= int(ends[to - 1]) - done
                at = to
            elif rows:
                yield from _of_texts(rows)
                rows, room = [], HELD
                returned(None)
            else:
                yield from _of_long(b.slice(at, 1))
                at += 1
    if rows:
        yield from _of_texts(rows)
    rows = None
    returned(None)


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group and documents that hold it; one row with the term '' per group."""
    return docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str, total: str) -> Column:
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * ({count} + {SMOOTH})) div greatest({total} + {SMOOTH} * v, 1)")


def _cell(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of a cell: pairs of a source of its low group block and one of its high block."""
    lang, low, high, _ = key
    got = got.sort_values("source")
    width = int(got["width"].iloc[0])
    dense = np.repeat(got["p0"].to_numpy(np.int64)[:, None], width, axis=1)
    for row, (at, p) in enumerate(zip(got["at"], got["p"], strict=True)):
        if at is not None and len(at):
            dense[row, at] = p
    names, block = got["source"].to_numpy(), got["group_block"].to_numpy()
    first, out = np.flatnonzero(block == low), []
    for i in first:
        others = first[first > i] if low == high else np.flatnonzero(block == high)
        part = np.abs(dense[others] - dense[i]).sum(axis=1)
        out += [(lang, names[i], names[j], int(f)) for j, f in zip(others, part, strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "f"])


def divergences(slices: DataFrame) -> DataFrame:
    """``lang, a, b, f`` for each unordered pair of sources of a language, from slices ``lang, source, group_block, group_blocks,
    term_block, width, p0, at, p``."""
    copies = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    cells = copies.withColumn("low", F.least("group_block", "other")).withColumn("high", F.greatest("group_block", "other"))
    parts = cells.groupBy("lang", "low", "high", "term_block").applyInPandas(_cell, "lang string, a string, b string, f long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def _blocks(n: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")


def _block(name: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(name), blocks).cast("int")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks the other sources of the language by divergence, part ``term`` the first
    ``TOP_TERMS`` terms that a source uses more than its language (ties: UTF-8 order of the item)."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    every = written(counts(docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(f"`{text}`").alias("text"))), "cube-counts")
    kept = every.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).drop("docs")
    sources = every.where("term = ''").groupBy("lang").agg(F.count("*").alias("groups"))
    langs = sources.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0, ["v", "lang_total"])
    langs = written(langs.withColumn("term_blocks", _blocks("v", TERMS)).withColumn("group_blocks", _blocks("groups", GROUPS)), "cube-langs")
    # kept terms: their block, and their number in it
    placed = sized_join(kept, langs.select("lang", "term_blocks"), "lang").withColumn("term_block", _block("term", F.col("term_blocks"))).drop("term_blocks")
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term")) - 1)
    used = written(big_join(every.where("term != ''").drop("docs"), placed, ["lang", "term"]), "cube-kept")
    widths = used.groupBy("lang", "term_block").agg((F.max("at") + 1).alias("width"))
    totals = used.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = sized_join(big_join(every.where("term = ''").select(*_GROUP), totals, _GROUP, "left").na.fill(0, ["total"]), langs, "lang")
    groups = written(groups.withColumn("group_block", _block("source", F.col("group_blocks"))), "cube-groups")
    release(every)

    rated = sized_join(used, groups.select(*_GROUP, "total", "lang_total", "v"), _GROUP).withColumn("p", _p("n", "total"))
    grid = groups.withColumn("p0", _p("0", "total"))
    return _ranked(rated, grid, widths)


def _ranked(rated: DataFrame, grid: DataFrame, widths: DataFrame) -> DataFrame:
    slices = rated.groupBy(*_GROUP, "term_block").agg(F.collect_list(F.struct("at", "p")).alias("own"))
    wanted = grid.select(*_GROUP, "group_block", "group_blocks", "p0", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
    wanted = big_join(wanted, widths, ["lang", "term_block"], "left").na.fill(0, ["width"])
    slices = big_join(wanted, slices, [*_GROUP, "term_block"], "left").withColumn("at", F.col("own.at")).withColumn("p", F.col("own.p")).drop("own")
    half = divergences(slices)
    pairs = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("f").alias("value"))
    pairs = pairs.unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), F.col("f").alias("value")))
    terms = rated.withColumn("value", F.col("p") - _p("lang_n", "lang_total")).where("value > 0").select(*_GROUP, F.col("term").alias("item"), "value")
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
