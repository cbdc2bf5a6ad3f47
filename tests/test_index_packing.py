"""Packed postings of the keyword index: what they hold, and how little is shuffled for them."""

import random

from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.operators import text_index
from memloom.operators.tables import new_path


def test_places_of_every_word(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 2)
    monkeypatch.setattr(text_index, "PACK_ROWS", 5)
    rng = random.Random(3)
    rows = {i: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for i in range(60)} | {60: None, 61: "", 62: "z" * 30}
    index = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], t.plain_tokens)
    index.add(spark.createDataFrame(list(rows.items()), "id long, text string").repartition(3))
    index.remove(spark.createDataFrame([(i,) for i in range(0, 60, 4)], "id long"))
    index.merge()
    now = index.manifest.read()[1]
    packed = index._table(now, "postings")
    for r in packed.collect():
        assert r.n == len(r.docs) == len(r.lens) == len(r.places) and r.most == max(map(len, r.places)) and r.shortest == min(r.lens)
        assert {d >> 2 for d in r.docs} == {r.block}
    found = text_index.unpacked(packed).join(index._table(now, "docs").select("id", "seg", "doc"), ["seg", "doc"])
    got = sorted((r.id, r.term, r.len, list(r.at)) for r in found.collect())
    want = []
    for i, x in rows.items():
        words = (x or "").split() if i % 4 or i >= 60 else []
        want += [(i, w, len(words), [k for k, y in enumerate(words, 1) if y == w]) for w in set(words)]
    assert got == sorted(want)


def test_a_row_for_each_term_and_block(spark):
    """One row for each word of a text was shuffled, with its term: three times what the texts hold."""
    rows = spark.range(400).select("id", F.lit("one two three four five six seven eight nine ten " * 5).alias("text")).coalesce(1)
    index = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], t.plain_tokens)
    index.add(rows)
    assert index._table(index.manifest.read()[1], "postings").count() == 10


def test_parts_hold_a_bounded_number_of_words(spark, monkeypatch):
    """Packed rows were shuffled by term, and a part of them was as large as the shuffle made it."""
    monkeypatch.setattr(text_index, "BLOCK_BITS", 3)
    monkeypatch.setattr(text_index, "PART_WORDS", 400, raising=False)
    index = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], t.plain_tokens)
    index.add(spark.range(160).select("id", F.lit("one two three four five " * 4).alias("text")).repartition(2))
    packed = index._table(index.manifest.read()[1], "postings")
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part")
    words = packed.select(part, "term", "block", F.explode("places").alias("at")).select("part", "term", "block", F.explode("at"))
    sizes = [r["count"] for r in words.groupBy("part").count().collect()]
    assert sum(sizes) == 3200 and len(sizes) > 4 and max(sizes) < 1000
    assert packed.count() == 5 * 20 and packed.select("term", "block").distinct().count() == 5 * 20  # blocks stay whole
