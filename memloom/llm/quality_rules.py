"""Quality rules with risk-controlled thresholds.

Every text gets integer measures. A rule rejects a text whose measure exceeds a cutoff. Labelled texts, copies counted
once, are dealt into a selection part, whose good texts give candidate cutoffs, and a larger holdout part, on which the
false rejections that each candidate adds to the base rules' are bounded by the exact (Clopper-Pearson) binomial limit,
over all good texts. Candidates are tested from the most lenient on (fixed sequence, which costs no level).
Half of the level goes to the pool of all texts, the other half is divided by the number of strata (Bonferroni). So with
probability 1 - ``delta``, each stratum with cutoffs of its own adds false rejections of at most ``alpha`` of its good
texts, and the pool's cutoffs, which the strata with too few labels for their own take, add at most ``alpha`` over the pool.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows, materialize

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "[#*$%&|<>]"
#: Candidates, tested in this order: steps by which cutoffs lie above the greatest measure of good texts of the selection
#: part, then fractions of these that each single rule may reject.
MARGINS = (64, 32, 16, 8, 4, 2, 1, 0)
LEVELS = (0.0005, 0.001, 0.002, 0.004, 0.007, 0.01)
CANDIDATES = len(MARGINS) + len(LEVELS)
#: Labelled texts, of ten, that select; the others hold out.
SELECTING = 4
#: Stands for the pool among the strata.
POOL = "\0pool"
#: Measures that the rules hold against a cutoff, on a square-root scale from 0 to STEPS; high values are bad.
RULES = ("r_symbols", "r_dup_lines", "r_repeat", "r_upper", "r_marks", "r_same_words", "r_long_words", "r_short_words")
#: Strata up to which their cutoffs are broadcast; beyond, the join is shuffled.
BROADCAST_STRATA = 100_000

STEPS = 127

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} int" for r in RULES)


def repeated_words(words: list[str], width: int = 8) -> int:
    """Words covered by ``width``-word windows that occur twice or more in the text, first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (ids[i : n - width + 1 + i] ^ (ids[i : n - width + 1 + i] >> np.uint64(29)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    # equal hashes stand for equal windows unless 64 bits collide; compare the words of neighbours to be exact
    hit = np.zeros(len(mixed), bool)
    for k in np.flatnonzero(same):
        a, b = order[k], order[k + 1]
        if words[a : a + width] == words[b : b + width]:
            hit[a] = hit[b] = True
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text; null has no words."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS[1:-1]))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    letters = max(1, chars)
    upper = sum(map(str.isupper, words))
    marks = text.count("!") + text.count("?")
    longest = max(map(len, words), default=0)
    parts = (symbols / letters, dup / max(1, lines), repeat / max(1, n), upper / max(1, n), marks / letters, 1 - len(set(words)) / max(1, n), longest / 1000, 1 - min(1.0, chars / max(1, n) / 20))
    return (n, chars, symbols, dup, repeat, *(min(STEPS, int(STEPS * math.sqrt(x))) for x in parts))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and the measures of column text."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def make():
        def step(part: pa.RecordBatch) -> dict:
            rows = [measures(t) for t in part.column("text").to_pylist()]
            return {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return step

    return map_rows(docs.select(*keep, "text"), MEASURES, make, keep=keep)


def binomial_upper(k: int, n: int, level: float) -> float:
    """Exact upper limit of a rate after ``k`` of ``n``: the p at which P(X <= k) falls to ``level``."""
    if n == 0 or k >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(log_choose)) if p < 1 else 0.0
        low, high = (p, high) if tail > level else (low, p)
    return high


def passes(k: int, n: int, level: float, alpha: float) -> bool:
    """Whether the exact upper limit of a rate after ``k`` of ``n`` is at most ``alpha``: P(X <= k) at alpha is at most ``level``."""
    if k >= alpha * n:
        return False
    choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    return sum(math.exp(c + i * math.log(alpha) + (n - i) * math.log1p(-alpha)) for i, c in enumerate(choose)) <= level


def _by_rule(name: str) -> Column:
    """The values of column ``name`` as an array in the order of RULES."""
    return F.transform(F.array_sort(F.collect_list(F.struct("rule", name))), lambda x: x[name]).alias(name)


def cutoffs(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, level and cutoffs (an array in the order of RULES) for each stratum of ``labelled(tag, stratum, good, base_failed,
    <RULES>)`` and the POOL in which a candidate passes; level is the place of the strictest candidate up to which all pass.

    Equal texts have equal tags and are one trial. Only histograms of the measures (STEPS + 1 bins) and counts leave the
    rows, so nothing here grows with a stratum.
    """
    names = ("base_failed", *RULES)
    texts = labelled.groupBy("stratum", "tag").agg(F.min("good").alias("good"), *[F.first(c).alias(c) for c in names]).filter("good")
    rows = texts.select(F.explode(F.array("stratum", F.lit(POOL))).alias("stratum"), "tag", *names)
    selects = F.pmod(F.xxhash64(F.lit("half"), "tag"), F.lit(10)) < SELECTING
    long = rows.filter(selects & ~F.col("base_failed")).select("stratum", F.posexplode(F.array(*RULES)).alias("rule", "bin"))
    bins = long.groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("stratum", "rule")
    bins = bins.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)) / F.sum("n").over(every))
    some = [F.least(F.max("bin") + m, F.lit(STEPS)) for m in MARGINS] + [F.min(F.when(F.col("above") <= level, F.col("bin"))) for level in LEVELS]
    per_rule = bins.groupBy("stratum", "rule").agg(*[c.alias(f"c{i}") for i, c in enumerate(some)])
    grid = per_rule.groupBy("stratum").agg(*[_by_rule(f"c{i}") for i in range(CANDIDATES)])
    n_strata = max(1, labelled.select("stratum").distinct().count())
    if n_strata <= BROADCAST_STRATA:
        grid = F.broadcast(grid)
    fired = lambda i: ~F.col("base_failed") & F.exists(F.arrays_zip(F.array(*RULES).alias("v"), F.col(f"c{i}").alias("c")), lambda x: x["v"] > x["c"])
    held = rows.filter(~selects).join(grid, "stratum")
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.count_if(fired(i)) for i in range(CANDIDATES)]).alias("rejected"))

    def passed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = []
            for stratum, n, rejected in zip(frame["stratum"], frame["n"], frame["rejected"], strict=True):
                share = delta / 2 if stratum == POOL else delta / 2 / n_strata
                best.append(next((i for i, k in enumerate(rejected) if not passes(int(k), int(n), share, alpha)), CANDIDATES) - 1)
            yield pd.DataFrame({"stratum": frame["stratum"], "level": best})

    levels = counts.mapInPandas(passed, "stratum string, level int")
    chosen = levels.filter("level >= 0").join(grid, "stratum")
    return chosen.select("stratum", "level", F.element_at(F.array(*[F.col(f"c{i}") for i in range(CANDIDATES)]), F.col("level") + 1).alias("cutoffs"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """All measures of every document of ``docs(doc_id, text, <stratum>)`` and the verdicts base_failed and kept.

    ``labels(doc_id, quality)``: quality 1 marks good texts; of several labels of a document or of equal texts the smallest
    counts. Columns level (of the candidates, -1 for none) and guarantee (stratum, pool or none) say which cutoffs judge a row.
    Null text: no words, so base_failed. Very long texts: measured whole. Null stratum: a stratum of its own. Repeated rows are
    judged each. No labels: only the base rules reject. No rows: no rows. Other columns are ignored.
    """
    keys = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    rows = measured(keys, ["doc_id", "stratum", "tag"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "measures")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    labelled = rows.join(known.withColumn("good", F.col("good") == 1), "doc_id")
    limits = materialize(cutoffs(labelled, alpha, delta), "cutoffs")
    own = limits.filter(F.col("stratum") != POOL)
    if limits.count() <= BROADCAST_STRATA:
        own = F.broadcast(own)
    pool = limits.filter(F.col("stratum") == POOL).agg(F.first("level").alias("pool_level"), F.first("cutoffs").alias("pool_cutoffs"))
    out = rows.join(own, "stratum", "left").crossJoin(F.broadcast(pool))
    cut = F.coalesce("cutoffs", "pool_cutoffs")
    rejected = F.coalesce(F.exists(F.arrays_zip(F.array(*RULES).alias("v"), cut.alias("c")), lambda x: x["v"] > x["c"]), F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~rejected)
    guarantee = F.when(F.col("level").isNotNull(), "stratum").when(F.col("pool_level").isNotNull(), "pool").otherwise("none")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", F.coalesce("level", "pool_level", F.lit(-1)).alias("level"), guarantee.alias("guarantee"), *RULES)
