"""Importance resampling towards a target distribution, over hashed word runs.

Features of a text are hashed into buckets. Postings (bucket, document, count) are packed by blocks of documents and ranges of
buckets and shuffled by both; each group meets the counts of its buckets in both corpora, computes the buckets' gains there,
and emits one contribution for each of its documents. Contributions are summed by document, Gumbel noise is added, and the
greatest scores are drawn.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, numbered, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = 10_000
#: Documents of a block, and ranges that the buckets are divided into: a group has the postings of one block in one range.
BLOCK, RANGES = 4096, 8
#: Words whose bucket a task keeps at hand.
CACHE = 1 << 18


def features(docs: DataFrame, key: str, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, buckets and counts (arrays, by bucket) of every text: runs of 1 to ``n`` words, hashed; null has none."""

    def make():
        cache: dict[str, int] = {}

        def bucket(run: str) -> int:
            found = cache.get(run)
            if found is None:
                if len(cache) >= CACHE:
                    cache.clear()
                found = cache[run] = zlib.crc32(run.encode("utf-8", "surrogatepass")) % buckets
            return found

        def step(batch: pa.RecordBatch) -> dict:
            sizes, ids, counts = [], [], []
            for value in batch.column("text"):
                words = WORD.findall((value.as_py() or "").translate(LOWER))
                runs = list(map(bucket, words))
                for k in range(2, n + 1):
                    runs += [bucket(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
                found, times = np.unique(np.array(runs, np.int32), return_counts=True)
                sizes.append(len(runs))
                ids.append(found)
                counts.append(times)
            return {"n_features": sizes, "buckets": ids, "counts": counts}

        return step

    return map_rows(docs, "n_features long, buckets array<int>, counts array<int>", make, keep=(key,))


def totals(found: DataFrame, name: str) -> DataFrame:
    """bucket and its count in a corpus; summed before the shuffle, so no more than one row for each bucket leaves a task."""
    return found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p")).groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias(name))


def postings(found: DataFrame, width: int) -> DataFrame:
    """Packed postings of ``features`` by block and range: block, range, docs, buckets, counts (arrays of equal length)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            lists = batch.column("buckets")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, times = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            docs = np.repeat(batch.column("_doc").to_numpy(), sizes)
            group = (docs // BLOCK) * RANGES + ids // width
            order = np.argsort(group, kind="stable")
            group, docs, ids, times = group[order], docs[order], ids[order], times[order]
            cuts = np.flatnonzero(np.diff(group)) + 1
            starts = np.concatenate([[0], cuts]) if len(group) else np.empty(0, np.int64)
            offsets = pa.array(np.concatenate([starts, [len(group)]]) if len(group) else [0], pa.int32())
            lists_of = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))  # noqa: E731, B023
            first = group[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(first // RANGES, pa.int64()), pa.array(first % RANGES, pa.int32()), lists_of(docs, pa.int64()), lists_of(ids, pa.int32()), lists_of(times, pa.int32())],
                ["block", "range", "docs", "buckets", "counts"],
            )

    return found.select("_doc", "buckets", "counts").mapInArrow(pack, "block long, range int, docs array<long>, buckets array<int>, counts array<int>")


def gain(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """Thousandfold log ratio of a bucket's smoothed shares in the target and in the corpus, rounded down."""
    s, t = s.astype(float), t.astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def contributions(packed: DataFrame, counts: DataFrame, all_s: int, all_t: int, buckets: int) -> DataFrame:
    """_doc and weight, one row for each document of a block and range: postings co-grouped with their buckets' counts."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        flat = lambda table, name: table.column(name).combine_chunks().flatten().to_numpy() if table.num_rows else np.empty(0, np.int64)
        worth = np.zeros(buckets, np.int64)
        worth[flat(right, "ids")] = gain(flat(right, "s"), flat(right, "t"), all_s, all_t, buckets)
        docs, ids, times = (flat(left, c) for c in ("docs", "buckets", "counts"))
        rows, place = np.unique(docs, return_inverse=True)
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, place, worth[ids] * times.astype(np.int64))
        return pa.table({"_doc": pa.array(rows, pa.int64()), "weight": pa.array(out, pa.int64())})

    return packed.groupBy("block", "range").cogroup(counts.groupBy("block", "range")).applyInArrow(join, "_doc long, weight long")


def weigh(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight; a table. ``target`` is the corpus to come near to."""
    rows = docs.select("doc_id", "text").withColumn("_doc", F.monotonically_increasing_id())
    ids = materialize(features(rows.select(F.struct("doc_id", "_doc").alias("_key"), "text"), "_key", n, buckets), "features")
    ids = ids.select("_key.doc_id", "_key._doc", "n_features", "buckets", "counts")
    other = features(target.select(F.lit(0).alias("_key"), "text"), "_key", n, buckets)
    counts = totals(ids, "s").join(totals(other, "t"), "bucket", "full").na.fill(0, ["s", "t"])
    # no more rows than there are buckets, and one array for each range
    width = -(-buckets // RANGES)
    counts = materialize(counts, "totals")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    by_range = counts.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(*[F.collect_list(c).alias(name) for c, name in (("bucket", "ids"), ("s", "s"), ("t", "t"))])
    # the counts go to every block, as one row for each block and range
    blocks = ids.select(F.floor(F.col("_doc") / BLOCK).alias("block")).distinct()
    spread = blocks.crossJoin(F.broadcast(by_range))
    parts = contributions(postings(ids, width), spread, all_s or 0, all_t or 0, buckets)
    each = ids.select("_doc", F.lit(0).cast("long").alias("weight"), F.struct("doc_id", "n_features").alias("row"))
    parts = each.unionByName(parts.withColumn("row", F.lit(None).cast(each.schema["row"].dataType)))
    summed = parts.groupBy("_doc").agg(F.sum("weight").alias("weight"), F.first("row", ignorenulls=True).alias("row"))
    return materialize(summed.select("row.doc_id", "row.n_features", "weight", "_doc"), "weights")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandfold Gumbel noise of a document, rounded down: a function of seed and id, so reruns agree."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, n: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, rank; the ``percent`` greatest scores have a rank, from 1.

    Drawn are documents with ``least`` features or more, ties to the smaller doc_id, null last; rows of one id and score in an order of
    their own, each with a rank. Weighted draws without replacement: the greatest of weight plus Gumbel noise.

    Null or empty text: no features, weight 0, not drawn. An empty target has no counts, so gains follow the corpus alone. Repeated
    rows count each. Very long texts count whole. No rows: no rows. Other columns are ignored.
    """
    rows = weigh(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    able = F.col("n_features") >= least
    drawn = rows.agg(F.count_if(able)).first()[0] * percent // 100
    ranked = numbered(rows.filter(able).select("_doc", "score", "doc_id"), "_rank", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_doc")
    ranked = ranked.filter(F.col("_rank") < drawn).select("_doc", (F.col("_rank") + 1).alias("rank"))
    return rows.join(ranked, "_doc", "left").select("doc_id", F.col("n_features").cast("long").alias("n_features"), "weight", "score", "rank")


#: Of each distinct word the CRC-32 is computed from its bytes and a table that is made from the polynomial.
ORACLE = r"""
WITH tbl AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {target}),
dw AS (SELECT i, w, count(*)::BIGINT AS n FROM (SELECT i, unnest(w) AS w FROM d) GROUP BY ALL),
gw AS (SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(w) AS w FROM g) GROUP BY ALL),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM gw), tbl),
s AS (SELECT b, sum(n)::BIGINT AS s FROM dw JOIN h USING (w) GROUP BY b), t AS (SELECT b, sum(n)::BIGINT AS t FROM gw JOIN h USING (w) GROUP BY b),
v AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS v FROM s LEFT JOIN t USING (b)),
x AS (SELECT i, sum(n * v)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN v USING (b) GROUP BY i),
y AS (SELECT i, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score FROM d LEFT JOIN x USING (i)),
r AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM y LEFT JOIN r USING (i)
"""
