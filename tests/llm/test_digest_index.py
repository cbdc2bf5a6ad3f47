import random

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from memloom.llm import digest_index as x
from memloom.llm.common import new_path


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n int")


def rows(n=400, seed=5):
    rng = random.Random(seed)
    texts = [f"text  {i}" for i in range(40)] + ["", None, " ", "\t", "a b", "a b", "a \n b", "x" * 50_000]
    out = [(rng.randrange(300) if rng.random() < 0.95 else None, rng.choice(texts), "d", 1) for _ in range(n)]
    return out + [(i, "copied  everywhere", "d", 1) for i in range(1000, 3500)]


def test_against_sql(spark, tmp_path):
    docs = documents(spark, rows())
    pq.write_table(docs.toArrow(), tmp_path / "d.parquet")
    got = x.report(docs)
    want = duckdb.sql(x.ORACLE.format(docs=f"'{tmp_path}/d.parquet'"))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_one_more_or_fewer_batches(spark):
    docs = documents(spark, rows(200, 8))
    one, five = (sorted(map(repr, x.report(docs, n).collect())) for n in (1, 5))
    assert one == five


def test_index_stays_and_batches_repeat(spark):
    path = new_path(spark, "index")
    index = x.DigestIndex.create(spark, path, buckets=3)
    first = documents(spark, [(7, "a", "", 0), (3, "b  c", "", 0), (9, "b c", "", 0)])
    second = documents(spark, [(1, "b c", "", 0), (2, "d", "", 0), (2, "d", "", 0), (None, "e", "", 0)])
    assert sorted((r.doc_id, r.text, r.n) for r in x.deduplicate(first, index, "one").collect()) == [(3, "b  c", 0), (7, "a", 0)]
    index.close()
    again = x.DigestIndex.open(spark, path)
    assert again.buckets == 3
    for _ in range(2):  # a batch that is run again gives the same and adds nothing
        assert sorted(map(repr, (r.doc_id for r in x.deduplicate(second, again, "two").collect()))) == ["2", "None"]
        assert again.rows().count() == 4
    small = again.compacted(new_path(spark, "index"))
    assert sorted(map(repr, small.rows().collect())) == sorted(map(repr, again.rows().collect()))
    assert small.rows().select(F.input_file_name()).distinct().count() <= 3


def test_the_index_is_not_shuffled(spark):
    index = x.DigestIndex.create(spark, new_path(spark, "index"), buckets=8)
    groups = x.signatures(documents(spark, rows(50))).select("digest", F.col("doc_id").alias("keep_id")).dropDuplicates(["digest"])
    index.append(groups, "one")
    plan = index.missing(groups)._jdf.queryExecution().executedPlan().toString()
    known = plan[plan.rindex("Scan parquet"):] if "Scan parquet" in plan else plan
    assert "SortMergeJoin" in plan and "Bucketed: true" in known
    assert index.missing(groups).count() == 0


def test_odd_tables(spark):
    assert x.report(documents(spark, []).limit(0)).collect() == []
    same = x.report(documents(spark, [(None, None, "", 0), (None, "", "", 0), (4, None, "", 0)])).collect()
    assert {(r.keep_id, r.group_size) for r in same} == {(4, 3)} and sum(r.kept for r in same) == 1
    named = spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in x.report(named).collect()} == {("a", "a", True), ("b", "a", False)}
