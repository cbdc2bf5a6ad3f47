import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import substring_index
from memloom.operators.tables import new_path

WORDS = ["Alpha", "beta", "GAMMA", "straße", "Ünïted", "100%", "under_score", "日本語テキスト", "ab", "a\\b", "naïve", "İstanbul"]


@pytest.fixture(scope="module")
def index(spark):
    """An index after replacements and removals, and the texts that it should hold."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
    now = {f"k{i}": text() for i in range(120)}
    out = substring_index.SubstringIndex(spark, new_path(spark, "substrings"))
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "key string, text string")
    out.add(0, frame(now))
    later = {f"k{i}": rng.choice([text(), None]) for i in range(0, 150, 4)}
    for _ in range(2):  # a batch that is run again
        out.add(1, frame(later))
    return out, frame(now | later)


PATTERNS = ["%alpha%", "%ALPHA beta%", "%gam_a%", "%under\\_score%", "%100\\%%", "%ab%", "a%", "%", "", "%straße%", "%ünï%", "%日本語%", "%語テ%", "beta", "%beta%alpha%", "%zzz%", "%a\\\\b%", "%ISTANBUL%", "%i̇stan%"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_a_scan(index, pattern):
    found, rows = index
    want = sorted(map(tuple, rows.filter(F.col("text").ilike(pattern)).collect()))
    assert sorted(map(tuple, found.search(pattern).collect())) == want
    if found.tested is not None:
        assert len(want) <= found.tested


def test_few_rows_are_tested(index):
    found, rows = index
    found.search("%ünïted alpha%").collect()
    assert found.tested is not None and found.tested < rows.count() // 2
    found.search("%ab%").collect()
    assert found.tested is None  # shorter than a gram


def test_many_candidates_and_no_rows(spark, index, monkeypatch):
    found, rows = index
    monkeypatch.setattr(substring_index, "LISTED", 3)
    want = sorted(map(tuple, rows.filter(F.col("text").ilike("%alpha%")).collect()))
    assert sorted(map(tuple, found.search("%alpha%").collect())) == want and found.tested > 3
    none = substring_index.SubstringIndex(spark, new_path(spark, "substrings"))
    assert none.search("%abc%") is None and none.search("%") is None
    assert substring_index.pieces("a\\%b%c_d\\") == ["a%b", "c", "d\\"]


def test_parts_follow_the_rows(spark, monkeypatch):
    """Grams and rows are dealt into parts of bounded rows, which adaptive execution would make larger the more there are."""
    from memloom.operators import upsert_log

    monkeypatch.setattr(upsert_log, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(substring_index, "PART_GRAMS", 1000, raising=False)
    made = substring_index.SubstringIndex(spark, new_path(spark, "substrings"))
    made.add(0, spark.range(600).selectExpr("cast(id as string) key", "concat('number ', 1000 + id) text"))
    grams = spark.read.schema(substring_index.GRAMS).parquet(f"{made.path}/grams/*")
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    sizes = [r["count"] for r in grams.groupBy(part).count().collect()]
    assert sum(sizes) == 600 * 9 - 1 and len(sizes) > 4 and max(sizes) < 1500  # 1111 has a gram twice
    parts = made.rows.table().rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(parts) == 6 and sum(parts) == 600
    assert made.search("%ber 1%7").count() == 60
