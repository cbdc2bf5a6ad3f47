"""Keyword, vector and fused search, and windowed reads."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions.text import Porter, QueryError, matches, parse_query, phrases_of, query_tokens, scored_starts, tokens
from memloom.operators.tables import stored

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def index(docs: DataFrame, keys: list[str], toks: Column, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (term, keys, tf, len) of ``docs`` and one row of corpus statistics (n_docs, avg_len).

    With ``terms`` the postings of these only: other tokens go inside a document's row, before it is exploded. All terms
    of all documents make a table to store, sorted by term; ``bm25`` then reads the terms of a query from it.
    """
    wanted = lambda t: t if terms is None else F.filter(t, lambda x: x.isin(*terms))
    rows = docs.select(*keys, F.inline(F.transform(F.array(toks), lambda t: F.struct(F.size(t).alias("len"), wanted(t).alias("t")))))
    postings = rows.select(*keys, "len", F.explode("t").alias("term")).groupBy("term", *keys, "len").agg(F.count("*").alias("tf"))
    return postings, rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def term_counts(docs: DataFrame, keys: list[str], toks: Column, terms: list[str]) -> DataFrame:
    """keys, len and tf (an array in the order of ``terms``) of every document, in one pass and without a shuffle."""
    count = lambda kept, word: F.size(F.filter(kept, lambda x: x == word))
    kept = F.transform(F.array(toks), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(*terms)).alias("t")))
    return docs.select(*keys, F.inline(F.transform(kept, lambda x: F.struct(x["len"].alias("len"), F.array(*[count(x["t"], w) for w in terms]).alias("tf")))))


def bm25_scan(counts: DataFrame, keys: list[str], n_terms: int) -> DataFrame:
    """Documents with all terms and their score, from ``term_counts``: a document's counts stay in its row, so that only the
    corpus statistics are aggregated, map-side, into one row. Both read ``counts``: store it, so that texts are read once."""
    tf = lambda i: F.element_at("tf", i + 1)
    stats = counts.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(tf(i) > 0).alias(f"df{i}") for i in range(n_terms)])
    hits = counts.filter(F.forall("tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    return hits.select(*keys, reduce(lambda a, b: a + b, [idf(F.col("n_docs"), F.col(f"df{i}")) * tf(i) * (K1 + 1) / (tf(i) + norm) for i in range(n_terms)]).alias("score"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def bm25(postings: DataFrame, stats: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """Rows with all ``terms`` by score, greater is better; statistics are those of the whole corpus."""
    terms = list(dict.fromkeys(terms))
    hits = postings.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    part = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy(*keys).agg(F.sum(part).alias("score"), F.count("*").alias("_n")).filter(F.col("_n") == len(terms)).drop("_n")


def keyword_search(docs: DataFrame, query: str, keys: list[str], toks: Column, limit: int = 25, keep: Column | None = None, on_error: str = "empty", stem: Callable[[str], str] = Porter.stem) -> DataFrame:
    """BM25 over the full query grammar: keys, score. A query that the grammar rejects finds nothing, or with
    ``on_error="lenient"`` is read as plain words. ``keep`` filters hits, not the statistics; ``stem`` is what ``toks`` did to words."""
    try:
        tree = parse_query(query, stem)
    except QueryError:
        if on_error != "lenient":
            return docs.select(*keys, F.lit(0.0).alias("score")).limit(0)
        words = " ".join(f'"{w}"' for w in tokens(query))
        if not words:
            return docs.select(*keys, F.lit(0.0).alias("score")).limit(0)
        tree = parse_query(words, stem)
    phrases = phrases_of(tree)

    def found(kept: Column, size: Column) -> Column:
        return F.struct(size.alias("_len"), matches(kept, tree).alias("_hit"), *[F.size(scored_starts(kept, *p)).alias(f"_f{i}") for i, p in enumerate(phrases)])

    measured = F.transform(F.array(toks), lambda t: F.struct(F.size(t).alias("n"), query_tokens(t, tree).alias("kept")))
    # an inlined array is computed once: filters do not move below it
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    rows = docs.select(*keys, kept.alias("_keep"), F.inline(F.transform(measured, lambda x: found(x["kept"], x["n"]))))
    rows = stored(rows, "found")  # statistics and hits read the counts, and the texts are read once
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(phrases))])
    hits = rows.filter("_hit and _keep").crossJoin(F.broadcast(stats))
    parts = [idf(F.col("_n"), F.col(f"_d{i}")) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))) for i in range(len(phrases))]
    score = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    return hits.select(*keys, score.alias("score")).orderBy(F.col("score").desc(), *keys).limit(limit)


def similarity(embedding: Column, query: list[float]) -> Column:
    """Dot product with a query vector that stands in the plan as a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def knn(vectors: DataFrame, query: list[float], keys: list[str], k: int = 25, keep: Column | None = None, overfetch: int | None = None) -> DataFrame:
    """The ``k`` nearest rows: keys, sim. Filters come first; ``overfetch`` filters the nearest k * overfetch instead."""
    rows = vectors.withColumn("sim", F.round(similarity(F.col("embedding"), query), 6))
    order = [F.col("sim").desc(), *keys]
    if keep is None:
        rows = rows.orderBy(*order).limit(k)
    elif overfetch:
        rows = rows.orderBy(*order).limit(k * overfetch).filter(keep).orderBy(*order).limit(k)
    else:
        rows = rows.filter(keep).orderBy(*order).limit(k)
    return rows.select(*keys, "sim")


def rrf(lists: list[DataFrame], order: list[list[Column]], keys: list[str], k: int = 60, limit: int = 8) -> DataFrame:
    """Reciprocal rank fusion of short ranked lists: keys, score, first (list, rank); earlier lists win ties."""
    parts = []
    for i, (rows, by) in enumerate(zip(lists, order, strict=True)):
        ranked = rows.select(*keys, (F.row_number().over(Window.orderBy(*by)) - 1).alias("rank"))
        parts.append(ranked.select(*keys, "rank", F.lit(i).alias("list")))
    rows = reduce(DataFrame.unionByName, parts)
    fused = rows.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"), F.collect_set("list").alias("in"))
    via = F.when(F.size("in") > 1, "both").when(F.array_contains("in", 0), "keyword").otherwise("semantic")
    return fused.withColumn("via", via).orderBy(F.round("score", 12).desc(), "first").limit(max(1, min(limit, 25))).select(*keys, F.round("score", 9).alias("score"), "via")


#: What makes a vector of a text: a function from a Column of texts to one of arrays, all of one length. A model's is a pandas UDF
#: that loads it once in a worker; the two here need no model.
Embedder = Callable[[Column], Column]


def word_embedder(digits: int = 1) -> Embedder:
    """Words counted by the first ``digits`` hexadecimal digits of their MD5, unit length: expressions only, without Python."""

    def embed(text: Column) -> Column:
        slot = lambda w: F.conv(F.substring(F.md5(w), 1, digits), 16, 10).cast("int")
        slots = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), slot)
        counts = lambda s: F.transform(F.sequence(F.lit(0), F.lit(16**digits - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))
        length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        # the variables of lambdas hold what is used more than once
        each = F.transform(F.transform(F.array(slots), counts), lambda c: F.struct(c.alias("c"), F.greatest(length(c), F.lit(1e-9)).alias("l")))
        return F.element_at(F.transform(each, lambda p: F.transform(p["c"], lambda x: x / p["l"])), 1)

    return embed


def hashing_embedder(dim: int = 384, chars: int = 2000):
    """A deterministic embedder that needs no model: signed hashes of character trigrams, unit length."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, int]] = {}

        def slot(gram: str) -> tuple[int, int]:
            if gram not in cache:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                cache[gram] = (h % dim, 1 if h >> 63 else -1)
            return cache[gram]

        def one(text: str | None) -> np.ndarray:
            out = np.zeros(dim, np.float32)
            padded = f" {(text or '')[:chars].lower()} "
            for i in range(len(padded) - 2):
                at, sign = slot(padded[i : i + 3])
                out[at] += sign
            return out / max(1e-9, math.sqrt(float(out @ out)))

        for texts in batches:
            yield texts.map(one)

    return embed


# Reads ---------------------------------------------------------------------------------------------------------


def context_window(path: DataFrame, hits: DataFrame, window: int = 6) -> DataFrame:
    """Messages within ``window`` places of a hit on its conversation's active path; a hit off the path gives the whole.

    ``path(conv_key, native_id, pos)``; ``hits(conv_key, native_id)``. Returns the rows of ``path`` with rn.
    """
    at = path.withColumn("rn", F.row_number().over(Window.partitionBy("conv_key").orderBy("pos")))
    here = hits.select("conv_key", F.col("native_id").alias("_hit"))
    where = here.join(at.select("conv_key", F.col("native_id").alias("_hit"), F.col("rn").alias("_rn")), ["conv_key", "_hit"], "left")
    rows = at.join(where, "conv_key").filter(F.col("_rn").isNull() | (F.abs(F.col("rn") - F.col("_rn")) <= window))
    return rows.drop("_rn").withColumnRenamed("_hit", "hit")


def within_budget(rows: DataFrame, budget: int = 60_000, cap: int = 8_000) -> DataFrame:
    """Rows of each conversation, in order of pos, until their texts, cut to ``cap``, would exceed the budget; the first always stays."""
    w = Window.partitionBy("conv_key").orderBy("pos")
    cut = rows.withColumn("text", F.substring("text", 1, cap))
    cut = cut.withColumn("used", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_rn", F.row_number().over(w))
    return cut.filter((F.col("used") <= budget) | (F.col("_rn") == 1)).drop("_rn")


def parts(rows: DataFrame, size: int = 40_000) -> DataFrame:
    """Every part of every text: part (from 1), n_parts, text."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    return rows.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts")))).withColumn("text", F.substring(F.col("text"), (F.col("part") - 1) * size + 1, F.lit(size)))


def chunks(path: DataFrame, size: int = 12, cut: int = 1_200) -> DataFrame:
    """Active messages with text in chunks of ``size``: chunk_idx, local_id m1.., chunk date, text cut with a marker."""
    w = Window.partitionBy("conv_key").orderBy("pos")
    rows = path.filter(F.trim("text") != "").withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("chunk_idx", F.floor((F.col("rn") - 1) / size).cast("int")).withColumn("local_id", F.concat(F.lit("m"), F.col("rn")))
    first = F.first("created_at", ignorenulls=True).over(Window.partitionBy("conv_key", "chunk_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shown = F.when(F.length("text") > cut, F.concat(F.substring("text", 1, cut), F.lit(" [...truncated]"))).otherwise(F.col("text"))
    return rows.withColumn("chunk_date", F.substring(first, 1, 10)).withColumn("text", shown)
