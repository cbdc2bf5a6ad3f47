import duckdb
import pytest

from memloom.llm import mixing


@pytest.mark.parametrize("sizes", [{"a": 50, "b": 10, "c": 400, None: 3}, {"x": 5}, {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_against_sql(spark, tmp_path, sizes):
    rows, doc = [], 0
    for source, total in sizes.items():
        while total > 0:
            n = min(total, 1 + doc % 7)
            rows.append((doc, " ".join(["w"] * n), source))
            total, doc = total - n, doc + 1
    rows.append((doc, None, "empty source"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    got = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = duckdb.sql(mixing.ORACLE.format(docs=f"'{tmp_path}/d.parquet'")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    by = {}
    for r in mixing.mix_sources(docs).collect():
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(taken == int(target) for taken, target in by.values())
    total = sum(s for s in sizes.values())
    assert sum(t for _, t in by.values()) == pytest.approx(total)
