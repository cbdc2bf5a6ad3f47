import numpy as np
import xxhash

from memloom.llm import simhash


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows, distance=4):
    fps = {f for _, f in rows}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(fps)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return {(d, f"{f:016x}", least.get(root(f))) for d, f in rows}


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    want = naive_components([(d, naive_fingerprint(t)) for d, t in rows])
    assert len(got) == len(rows)
    assert set(got) == want


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    check(spark, [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one  two"), (7, long), (8, long + " end"), (4, "ÀB c d e"), (None, "one two"), (1, "One two"), (6, "a b c d\xa0e f g h")])


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def clustered(rng, n=400):
    out = rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist()
    for base in out[:20]:
        for _ in range(30):
            x = base
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


def test_links_reach_what_all_pairs_reach(spark, monkeypatch):
    fps = clustered(np.random.default_rng(3))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {frozenset(x) for x in _groups(fps)}
    for hot in (20_000, 20):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        roots = simhash.components(simhash.links(frame)).collect()
        by = {}
        for r in roots:
            by.setdefault(r.root, set()).add(r.node % (1 << 64))
        assert {frozenset(x) for x in by.values()} == want


def _groups(fps):
    groups = []
    for x in fps:
        near = [g for g in groups if any((x ^ y).bit_count() <= 4 for y in g)]
        groups = [g for g in groups if g not in near] + [{x}.union(*near)]
    return [g for g in groups if len(g) > 1]


def test_thresholds_keep_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    bits = (rng.random((5000, 64)) < rng.uniform(0.1, 0.9, 64)).astype(float)
    for n in (100, 10**6, 10**10):
        for parts in range(1, 9):
            groups = simhash.grouped_bits(bits.T @ bits, 5000, parts)
            assert sorted(b for g in groups for b in g) == list(range(64))
            _, chosen = simhash.thresholds(groups, bits.mean(0), n, 4)
            assert not chosen or sum(t + 1 for t in chosen) == 5
