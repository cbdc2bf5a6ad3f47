import hashlib
import random

import numpy as np

from memloom.llm import suffixes


def brute(rows):
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            first[w] = min(first.get(w, (1 << 63) - 1), (1 << 63) - 1 if d is None else d)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < ((1 << 63) - 1 if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(t, d, 3) for d, t in rows], "text string, doc_id long, group int")
    got = sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=repr)
    assert got == brute(rows)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_repetitive_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(None, None), (3, ""), (4, "short"), (5, "a" * 200), (6, "b" + "a" * 120), (7, "ab" * 90), (8, "a" * 49), (9, "é" * 60), (10, "x" + "é" * 40), (5, "a" * 200), (5, "ab" * 70), (None, "a" * 80)]
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    for d in range(20, 70):
        rows.append((d, "".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))))
    for d in (127, 128, 200, 255, 256, 33_000, 51_281, 1 << 40, (1 << 62) + 0x8182, -5, -200):
        rows += [(d, rows[-1][1]), (d + 7, "c" * (60 + d % 50))]
    rng.shuffle(rows)
    check(spark, rows)


def test_very_long_text(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(130_000))
    check(spark, [(2, long), (1, long[59_000:62_000] + "z" * 70_000), (3, "q" + long[:70_100] + "w" + long[70_101:]), (4, "z" * 66_000)])


def test_no_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_order_of_suffixes_against_sorting(monkeypatch):
    """Suffixes of repetitive contexts, at places of all residues, in the order of their bytes."""
    rng = np.random.default_rng(5)
    pool = rng.integers(97, 99, (6, suffixes.CONTEXT), dtype=np.uint8)
    block = pool[rng.integers(0, 6, 90)]
    block[rng.random(block.shape) < 0.01] = 120
    block[::7, 60:] = 0
    table = suffixes.cover_ranks(block)
    rows = np.repeat(np.arange(len(block)), suffixes.REACH + 1)
    offsets = np.tile(np.arange(suffixes.REACH + 1), len(block))
    order = suffixes.suffix_order(block, table, rows, offsets)
    texts = [block[r, o:].tobytes().rstrip(b"\0") for r, o in zip(rows[order], offsets[order], strict=True)]
    assert texts == sorted(texts) and sorted(order.tolist()) == list(range(len(rows)))


def test_buckets_do_not_matter(spark, monkeypatch):
    rng = random.Random(14)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 90))) for _ in range(9)]
    rows = [(d, "".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for d in range(50)]
    docs = [(d, t.encode()) for d, t in rows]
    blocks = np.stack([np.frombuffer(t[:80].ljust(80, b"x"), np.uint8) for _, t in docs])
    near, far = np.zeros(50, np.int64), np.full(50, suffixes.REACH)
    ids = np.arange(50)
    whole = suffixes.least_ids(blocks, ids, near, far)
    monkeypatch.setattr(suffixes, "BUCKET", 40)
    assert (suffixes.least_ids(blocks, ids, near, far) == whole).all()
    first = {}
    for d in ids:
        for o in range(31):
            first.setdefault(blocks[d, o : o + 50].tobytes(), d)
    assert all(whole[d, 30 - o] == first[blocks[d, o : o + 50].tobytes()] for d in ids for o in range(31))


def test_a_passage_of_all_documents_comes_twice_from_a_group(spark):
    """What a task gets of a hash that every document has follows the groups, not the documents; results stay those of brute force."""
    import pyarrow as pa

    header = "This licence header stands at the beginning of each of very many documents, word for word. "
    rows = [(i, header + f"tail {i} " * 9) for i in range(300)]
    left = pa.table({"doc_id": [d for d, _ in rows], "group": pa.array([0] * len(rows), pa.int32()), "text": [t for _, t in rows]})
    right = pa.table({"copy": pa.array([], pa.binary())})
    got = suffixes.anchor_hashes(left, right, 3)
    found: dict[int, list[int]] = {}
    for r in got.to_pylist():
        owner = np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.int32))
        for d, h in zip(owner.tolist(), suffixes.unpacked(r["low"], r["high"]).tolist(), strict=True):
            found.setdefault(h, []).append(d)
    assert max(map(len, found.values())) == 2 and [0, 299] in [sorted(x) for x in found.values()]
    out = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == 0 and all(out[i] >= len(header) for i in range(1, 300))
