import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

from memloom.llm import resampling as x
from tests.conftest import DATA


def runs(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10):
    hashed = lambda text: Counter(zlib.crc32(r.encode()) % buckets for r in runs(text, n))
    each = [hashed(text) for _, text in docs]
    s, t = sum(each, Counter()), sum(map(hashed, target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    worth = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (doc_id, _), found in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(worth[b] * c for b, c in found.items())
        out.append([doc_id, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted(map(repr, map(tuple, out)))


def documents(n=300, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)] + ["Straße", "ÀB", "Zoë", "語彙", "don't", "a-b"]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60)))) for i in range(n)]
    return texts + [(n, None), (n + 1, ""), (None, texts[0][1]), (5, texts[5][1]), (n + 2, "Word " * 30_000)]


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (1, 7), (2, 300)])
def test_against_brute_force(spark, monkeypatch, n, buckets):
    monkeypatch.setattr(x, "BLOCK", 16)
    docs, target = documents(), ["w1 w2 w3 Straße", None, "w400 w401 語彙 " * 20]
    got = x.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, target, n, buckets)


def test_against_sql(spark, tmp_path):
    docs = spark.createDataFrame(documents(80, 4), "doc_id long, text string")
    pq.write_table(docs.toArrow(), tmp_path / "d.parquet")
    sql = x.ORACLE.format(docs=f"'{tmp_path}/d.parquet'", target=f"'{DATA}/sf0.001/benchmark.parquet'")
    want = duckdb.sql(sql)
    got = x.resample(docs, spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet"))
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_no_target_and_no_rows(spark):
    docs = spark.createDataFrame(documents(30), "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    assert sorted(map(repr, map(tuple, x.resample(docs, nothing).collect()))) == brute(documents(30), [])
    assert x.resample(docs.limit(0), nothing).collect() == []
