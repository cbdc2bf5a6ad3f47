"""Every operator on nulls, empty and long texts, repeated rows, clashing columns, and empty tables."""

import pytest
from pyspark.sql import functions as F

from memloom.llm import cotraining, decontaminate, digest_index, html_text, language, lines, mixing, negatives, quality_rules, resampling, secrets, simhash, suffixes

LONG = "Ein langer Text mit vielen Wörtern. " * 3000
ROWS = [(1, "the cat and the dog of the house", "en", "a", 30), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "de", None, len(LONG)), (None, "le chat et la maison", "fr", "b", 20), (1, "the cat and the dog of the house", "en", "a", 30), (5, "12345 !!! \t\n 😀", None, "b", 5), (6, "der Hund und das Haus", "de", "c", 21)]
NAMES = ("size", "key", "range", "stratum", "group", "part", "fp", "root", "node", "lang_pred", "score", "spans", "_spans", "kept", "level", "removed", "_id", "pos", "line", "hash", "digest", "copy", "quality", "_pool", "target", "taken")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 1), (6, 0, 1), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the cat and the dog of the house"), (2, None), (3, "x"), (None, "nothing that is there at all")], "item_id long, text string")
    for n in NAMES:
        docs = docs.withColumn(n, F.lit(7))
        if n not in labels.columns:
            labels = labels.withColumn(n, F.lit(7))
        bench = bench.withColumn(n, F.lit(7))
    return docs, labels, bench


OPERATORS = {
    "quality_rules": lambda d, la, b: quality_rules.apply_rules(d, la),
    "suffixes": lambda d, la, b: suffixes.remove_repeats(d),
    "lines": lambda d, la, b: lines.report(d),
    "simhash": lambda d, la, b: simhash.near_duplicates(d),
    "mixing": lambda d, la, b: mixing.mix_sources(d),
    "language": lambda d, la, b: language.identify(d, language.train(d)),
    "secrets": lambda d, la, b: secrets.scan(d, secrets.train(d)),
    "cotraining": lambda d, la, b: cotraining.score(d, cotraining.train(d, la)),
    "decontaminate": lambda d, la, b: decontaminate.scan(d, b),
    "resampling": lambda d, la, b: resampling.resample(d, b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, tables, name):
    got = OPERATORS[name](*tables).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in ROWS)
    alike = [r for r in got if r.doc_id == 1]
    assert alike[0] == alike[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tables, name):
    docs, labels, bench = (t.limit(0) for t in tables)
    assert OPERATORS[name](docs, labels, bench).collect() == []
    got = OPERATORS[name](tables[0], labels, bench).collect()
    assert len(got) == len(ROWS)


def test_exact_dedup(spark, tables):
    got = digest_index.report(tables[0]).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in ROWS)
    assert {r.doc_id: r.keep_id for r in got if r.group_size > 1} == {1: 1, 2: 2, 3: 2} and sum(r.kept for r in got) == len(ROWS) - 2
    assert digest_index.report(tables[0].limit(0)).collect() == []


def test_vectors(spark):
    rows = [(50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.5], 2), (None, [1.0], 1), (3, None, 1), (4, [1.0, None], 2), (5, [], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    for n in ("cell", "block", "x", "far", "rank", "window", "score", "low", "high", "kth"):
        table = table.withColumn(n, F.lit(7))
    got = [tuple(r) for r in negatives.mine(table).collect()]
    assert got == [(50, 1, 1, 2, 256 * 256 + 128 * 64, 256 * 128 + 128 * 128)]
    assert negatives.mine(table.limit(0)).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>just a short text", "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    got = sorted((repr(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("None", "just a short text", 17)]
    assert html_text.extract(pages.limit(0)).collect() == []
