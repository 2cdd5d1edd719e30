"""URL filter: rules first, then the ratio of two character language models.

A rule ``host/path`` fits an url whose host is the rule's or a subdomain and whose path starts with the
rule's path; the longest fitting rule decides.  Urls that a rule decides teach two variable-order Markov
models over characters (accepted and rejected), with counts over *all* such urls, Witten-Bell smoothed: each context interpolates
with the one a character shorter, down to a uniform distribution.  Other urls get
``(log p_accepted - log p_rejected) / length``, turned into a probability by a logistic calibration fitted on
labelled urls that are held out of the counts.

Memory: n-gram counts are folded into ``2**bits`` slots per table by CRC-32, so a model has a fixed size
however many urls teach it; the calibration uses all held-out urls: their differences stay on the executors, which send sums to the driver.

Null url or one without ``://``: host and path are empty and no rule fits; the method judges the
text as it is (null as empty, which scores 0 before calibration).  If no url is accepted, or none
rejected, by rules, there is nothing to compare and every other url is allowed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ALLOW, BLOCK = "allow", "block"
_ALPHABET = 256  # of the uniform distribution: the texts are scored as UTF-8 bytes
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), _CAPITALS, _CAPITALS.lower()), F.regexp_extract(u, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (both null if none fits); ties go to the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(text: str, order: int) -> Iterator[bytes]:
    """All n-grams of 1 to ``order`` bytes that end at a byte of the text, with one start mark."""
    b = b"\x00" + text.encode("utf-8", "surrogatepass")
    for end in range(2, len(b) + 1):
        for n in range(1, min(order, end) + 1):
            yield b[end - n : end]


@dataclass
class CharModel:
    """Counts per slot: of n-grams, of contexts, and of the different bytes seen after a context."""

    order: int
    bits: int
    gram: np.ndarray
    context: np.ndarray
    kinds: np.ndarray

    def log_prob(self, text: str) -> float:
        """Log probability of the text's bytes, each given the up to ``order - 1`` bytes before it."""
        mask, total = (1 << self.bits) - 1, 0.0
        b = b"\x00" + text.encode("utf-8", "surrogatepass")
        for end in range(2, len(b) + 1):
            p = 1 / _ALPHABET
            for n in range(1, min(self.order, end) + 1):
                at = crc32(b[end - n : end - 1]) & mask
                seen = self.context[at]
                if not seen:
                    break
                t = self.kinds[at]
                p = (min(self.gram[crc32(b[end - n : end]) & mask], seen) + t * p) / (seen + t)
            total += math.log(p)
        return total


@dataclass
class UrlModel:
    accepted: CharModel
    rejected: CharModel
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, text: str | None) -> float:
        text = text or ""
        n = len(text.encode("utf-8", "surrogatepass"))
        return (self.accepted.log_prob(text) - self.rejected.log_prob(text)) / n if n else 0.0

    def accept_probability(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.difference(text) + self.shift))))


def _count(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(v, g, n) for (v, g), n in found.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["v", "g", "n"])

        for b in batches:
            for url, v in zip(b.u, b.v, strict=True):
                found.update((v, g) for g in grams(url, order))
                if len(found) > 200_000:
                    yield out()
        yield out()

    return run


def logistic(held: DataFrame) -> tuple[float, float] | None:
    """Slope and shift of least log loss over all rows ``d double, y boolean`` (targets pulled slightly inwards, so that they stay finite); None
    without rows of both kinds.  Every step is a sum over the rows."""
    sizes = held.agg(F.count(F.when(F.col("y"), 1)).alias("pos"), F.count(F.when(~F.col("y"), 1)).alias("neg")).first()
    if not sizes.pos or not sizes.neg:
        return None
    d = F.col("d")
    t = F.when(F.col("y"), (sizes.pos + 1) / (sizes.pos + 2)).otherwise(1 / (sizes.neg + 2))
    w = F.when(F.col("y"), 0.5 / sizes.pos).otherwise(0.5 / sizes.neg)  # both classes weigh the same
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(a) * d + F.lit(b)))))
        rows = held.select("d", (w * (p - t)).alias("g"), (w * p * (1 - p) + 1e-12).alias("h"))
        s = rows.agg(*(F.sum(c).alias(n) for n, c in (("gx", F.col("g") * d), ("g", F.col("g")), ("hxx", F.col("h") * d * d), ("hx", F.col("h") * d), ("h", F.col("h"))))).first()
        step = np.linalg.solve(np.array([[s.hxx + 1e-9, s.hx], [s.hx, s.h]]), np.array([s.gx, s.g]))
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return a, b


def train(urls: DataFrame, url: str, verdict: str, *, order: int = 6, bits: int = 18) -> UrlModel | None:
    """Learn from rows with a verdict; a tenth of the different urls is kept for calibration."""
    spark = urls.sparkSession
    rows = urls.select(F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{verdict}`").alias("v"))
    rows = rows.where(F.col("v").isin(ALLOW, BLOCK) & F.col("u").isNotNull())
    held = F.pmod(F.xxhash64("u"), F.lit(10)) == 0
    mask = (1 << bits) - 1
    counted = rows.where(~held).mapInPandas(_count(order), "v string, g binary, n long").groupBy("v", "g").agg(F.sum("n").alias("n"))
    slot = lambda c: F.crc32(c).bitwiseAND(F.lit(mask)).cast("int")
    both = counted.select(
        "v", "n", F.explode(F.array(
            F.struct(F.lit(0).alias("k"), slot(F.col("g")).alias("at")),
            F.struct(F.lit(1).alias("k"), slot(F.expr("substring(g, 1, length(g) - 1)")).alias("at")),
        )).alias("s"),
    )
    slots = both.groupBy("v", "s.k", "s.at").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # at most 4 * 2**bits rows
    models = {}
    for v in (ALLOW, BLOCK):
        own = slots[slots.v == v]
        if not len(own):
            return None
        arrays = [np.zeros(1 << bits, dtype=np.int64) for _ in range(3)]
        g, c = own[own.k == 0], own[own.k == 1]
        arrays[0][g["at"]], arrays[1][c["at"]], arrays[2][c["at"]] = g["n"], c["n"], c["kinds"]
        models[v] = CharModel(order, bits, *arrays)
    model = UrlModel(models[ALLOW], models[BLOCK])
    shared = spark.sparkContext.broadcast(model)

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"d": [shared.value.difference(u) for u in b.u], "y": b.v == ALLOW})

    kept = rows.where(held).groupBy("v", "u").count().mapInPandas(differences, "d double, y boolean")
    fitted = logistic(written(kept, "url-calibration"))
    if fitted:
        model.slope, model.shift = fitted
    return model


def judge(pages: DataFrame, url: str, rules: Sequence[tuple[str, str]], model: UrlModel | None) -> DataFrame:
    """``pages`` plus host, path, rule, verdict and accept_probability (columns of these names are replaced)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in urls:
            m = shared.value
            yield b.map(lambda u: 1.0 if m is None else m.accept_probability(u), na_action=None)

    names = ("host", "path", "rule", "verdict", "accept_probability")
    host, path = host_and_path(url)
    rule, says = matching_rule(F.col("__host"), F.col("__path"), rules)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names and c != url]
    out = pages.select(*kept, F.col(f"`{url}`").alias("__url"), host.alias("__host"), path.alias("__path"))
    out = out.select("*", rule.alias("__rule"), says.alias("__says"), probability(F.col("__url").cast("string")).alias("__p"))
    verdict = F.coalesce("__says", F.when(F.col("__p") >= 0.5, ALLOW).otherwise(BLOCK))
    return out.select(
        *kept, F.col("__url").alias(url), F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"), verdict.alias("verdict"), F.col("__p").alias("accept_probability"),
    )


def filter_urls(pages: DataFrame, url: str, rules: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Train on the urls that the rules decide and judge every row."""
    host, path = host_and_path(url)
    _, says = matching_rule(F.col("__host"), F.col("__path"), rules)
    taught = pages.select(F.col(f"`{url}`").alias("__url"), host.alias("__host"), path.alias("__path")).select("__url", says.alias("__says"))
    return judge(pages, url, rules, train(taught, "__url", "__says", **options))
