"""SimHash near-duplicate detection by the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into partitions, correlated bits together. A threshold for each partition
comes from a dynamic programme over estimated candidate counts: thresholds t_i >= -1 with sum(t_i + 1) = distance + 1,
so every pair within the distance agrees to within t_i in some partition i. Each distinct fingerprint is indexed by
its bits in every partition that is in use, probes all values within the partition's threshold, and candidates are
verified on all 64 bits. Buckets leave a spanning forest of their links, never all pairs; components follow from it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize
from .components import components

BITS = 64
SEED = 42
#: Rows of a bucket beyond which it is dealt out again, by a pigeonhole over other bits, and how often at most; such buckets are
#: looked for in one of SAMPLE fingerprints.
HOT_BUCKET, MOST_DEALS, SAMPLE = 20_000, 3, 16
#: Rows that one task of the verification takes, about.
TASK_ROWS = 1_000_000
#: Cost of a probe row in units of a verified candidate: 2.4 us to make, shuffle and sort one, 23 ns to verify one (measured).
PROBE_COST = 100.0


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned fingerprint over shingles of ``width`` words; 0 for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    n = len(words)
    if n == 0:
        return 0
    hash64, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= width:
        return hash64(joined, SEED)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[: n - width])]
    hashes = np.fromiter([hash64(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)], np.uint64, n - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(part: pa.RecordBatch) -> dict:
            values = np.fromiter((fingerprint(t, width) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            return {"doc_id": part.column("doc_id"), "fp": pa.array(values.view(np.int64))}

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, fp long", make)


def bit_moments(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all rows of ``fps(fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"m": [total.astype(np.int64).ravel().tolist()]}, schema=pa.schema([("m", pa.list_(pa.int64()))]))

    rows = fps.select("fp").mapInArrow(run, "m array<long>").select(F.posexplode("m").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.i] = r.n
    return out.reshape(BITS, BITS)


def grouped_bits(moments: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size; each group grows by the bit most correlated with it."""
    p = np.diag(moments) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((moments / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k) + (len(left) % (parts - k) > 0)
        free = sorted(left)
        group = [max(free, key=lambda b: corr[b, free].max())]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def thresholds(groups: list[list[int]], ones: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds of the groups, by dynamic programming over the shared budget.

    Estimates use the share of set bits over all fingerprints: a group's distance is a sum of bits that differ
    with probability 2p(1-p). The estimates decide the cost of a plan, never its results.
    """
    costs = []
    for group in groups:
        differ = np.array([1.0])
        for b in group:
            d = 2 * ones[b] * (1 - ones[b])
            differ = np.append(differ, 0) * (1 - d) + np.append(0, differ) * d
        costs.append([0.0] + [PROBE_COST * n * sum(math.comb(len(group), i) for i in range(t + 1)) + float(n) * n * float(differ[: t + 1].sum()) for t in range(min(distance, len(group)) + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in enumerate(cost):
                if used + t <= distance + 1 and (used + t not in new or total + c < new[used + t][0]):
                    new[used + t] = (total + c, [*chosen, t - 1])
        best = new
    return best.get(distance + 1, (math.inf, []))


def plan(moments: np.ndarray, n: int, distance: int) -> list[tuple[int, np.ndarray]]:
    """For each partition in use its bit mask and the flips to probe; the first flip is none, the index entry."""
    ones = np.diag(moments) / max(n, 1)
    best: tuple[float, list[list[int]], list[int]] = (math.inf, [], [])
    for parts in range(1, min(2 * (distance + 1), 12) + 1):
        groups = grouped_bits(moments, n, parts)
        cost, chosen = thresholds(groups, ones, n, distance)
        if cost < best[0]:
            best = (cost, groups, chosen)
    return [(sum(1 << b for b in group), flips(group, t)) for group, t in zip(best[1], best[2], strict=True) if t >= 0]


def flips(group: list[int], most: int) -> np.ndarray:
    """Masks with at most ``most`` bits of ``group``, by number of bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(group, k)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of unsigned longs."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def probe_rows(fps: DataFrame, parts: list[tuple[int, np.ndarray]]) -> DataFrame:
    """key, fp, probe: one row for each value that a fingerprint is indexed by (probe false) or looks for."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k, (mask, masks) in enumerate(parts):
                for at in range(0, len(values), 4096):
                    some = values[at : at + 4096]
                    keys = mixed(((some[:, None] & np.uint64(mask)) ^ masks[None, :]) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                    probe = np.broadcast_to(np.arange(len(masks)) > 0, keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64)), pa.array(probe.ravel())], schema=schema)

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def deal_masks(distance: int, level: int) -> list[int]:
    """Masks by which rows are dealt for the ``level``-th time: distance + 1 for each way through the levels before.

    Each way has agreed on its parts; the bits that are left are dealt out in turn, so that no part lies within the
    partition that filled the bucket.
    """
    ways: list[list[int]] = [list(range(BITS))]
    masks: list[int] = []
    for _ in range(level):
        masks, left = [], []
        for bits in ways:
            for k in range(distance + 1):
                masks.append(sum(1 << b for b in bits[k :: distance + 1]))
                left.append([b for i, b in enumerate(bits) if i % (distance + 1) != k])
        ways = left
    return masks


def dealt_again(rows: DataFrame, distance: int, level: int) -> DataFrame:
    """``rows(key, fp, probe, way)`` of hot buckets under finer keys: a pair within the distance agrees in one of distance + 1 parts
    of the bits that its way has not used."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in deal_masks(distance, level)])
    ways = F.sequence(F.col("way") * (distance + 1), F.col("way") * (distance + 1) + distance)
    each = rows.select("key", "fp", "probe", F.explode(ways).alias("way"))
    return each.select(F.xxhash64("key", F.lit(level), "way", F.col("fp").bitwiseAND(F.element_at(masks, F.col("way") + 1))).alias("key"), "fp", "probe", "way")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of a spanning forest of the links a-b, by least labels and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_links(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``distance`` that share a bucket with an index entry.

    Memory follows the number of rows: pairs are looked at one shift of the sorted rows at a time.
    """
    order = np.lexsort((fps, keys))
    keys, fps, probe = keys[order], fps[order], probe[order]
    first = np.append(True, keys[1:] != keys[:-1])
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    index = np.bincount(group, weights=~probe)
    use = ((size > 1) & (index > 0))[group]
    ends = np.append(np.flatnonzero(first)[1:], len(keys))[group]
    at = np.flatnonzero(use)
    found_a, found_b, held = [], [], 0
    shift = 1
    while True:
        at = at[at + shift < ends[at]]
        if not len(at):
            break
        near = (np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance) & (fps[at] != fps[at + shift])
        found_a.append(fps[at[near]])
        found_b.append(fps[at[near] + shift])
        held += int(near.sum())
        if held > 1_000_000:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        shift += 1
    if not found_a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fps(fp)`` that differ in at most ``distance`` bits."""
    n = fps.count()
    parts = plan(bit_moments(fps), n, distance)
    rows = probe_rows(fps, parts)
    n_rows = n * sum(len(m) for _, m in parts)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // TASK_ROWS + 1)
    # keys that very many rows have, index entries and probes alike, as a sample of the fingerprints shows them
    sample = probe_rows(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), parts)
    hot = materialize(sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BUCKET / SAMPLE).select("key"), "hot")
    if not hot.isEmpty():
        done, rest = rows.join(hot, "key", "left_anti"), rows.join(hot, "key", "left_semi").withColumn("way", F.lit(0))
        for level in range(1, MOST_DEALS + 1):
            rest = materialize(dealt_again(rest, distance, level), "dealt")
            hot = materialize(rest.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BUCKET).select("key"), "hot")
            if level == MOST_DEALS or hot.isEmpty():
                done = done.unionByName(rest.drop("way"))
                break
            done = done.unionByName(rest.join(hot, "key", "left_anti").drop("way"))
            rest = rest.join(hot, "key", "left_semi")
        rows = done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            a, b = bucket_links(*(np.concatenate(x) for x in zip(*got, strict=True)), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.repartition(tasks, "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id: the least doc_id reachable over links of at most ``distance`` bits.

    Null or empty text: fingerprint zero, linked like any other. Very long texts are read whole. Equal texts share a fingerprint
    and hence a component.
    Null doc_ids never name a component. Repeated rows return each. No rows: no rows. Other columns are ignored.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps, distance))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
