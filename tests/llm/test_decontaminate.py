import random

import pytest

from memloom.llm import decontaminate as d


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def want_of(items, text):
    """Items within a tenth of their length of a part of the text; without an edit to spare, as whole words."""
    data, out = d.normalise(text), set()
    for i, t in items:
        item = d.normalise(t)
        k = len(item) // 10
        if item and (edits(item, data) <= k if k else f" {item} " in f" {data} "):
            out.add(i)
    return out


def test_against_alignment_of_all():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 8, 30))))) for i in range(24)] + [(90, "?!"), (91, None), (92, "a")]
    index = d.build([(i, t) for i, t in items])
    items = [(i, t or "") for i, t in items]
    for n in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        if n % 4:
            chars = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(chars) // 8)) if chars else 0):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "x", chars[at] + "y"])
            text = f"{text} {''.join(chars)} {text}"
        assert {i for i, *_ in d.search(text, index)} == want_of(items, text)


SCRIPTS = {"han": [chr(0x4E00 + 37 * i) for i in range(400)], "cyrillic": [chr(c) for c in range(0x430, 0x450)], "thai": [chr(c) for c in (*range(0xE01, 0xE2F), 0xE31, 0xE34, 0xE48, 0xE49)], "accents": [*"abcde", "e\u0301", "u\u0308", "\u00e9", "o\u0302"], "mixed": [*"abc", "\u0436", "\u4e00", "\u0915\u093f", "\u1112\u1161\u11ab"]}


@pytest.mark.parametrize("script", SCRIPTS)
def test_scripts_against_alignment_of_all(script):
    """Edits are of code points in composed form, whatever the script, and a span begins and ends with the passage."""
    rng = random.Random(script)
    letters = SCRIPTS[script]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 3, 5, 9))))) for i in range(16)]
    index = d.build(items)
    for n in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 15)))
        whole = rng.choice(items)
        if n % 4:
            chars = list(whole[1])
            for _ in range(rng.randint(0, max(1, len(chars) // 8)) if n % 4 > 1 else 0):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "x", chars[at] + "y"])
            text = f"{text} \u2014 {''.join(chars)}, {text}"
        found = d.search(text, index)
        assert {i for i, *_ in found} == want_of(items, text)
        for i, s, t, e in found:
            part, item = d.normalise(text[s:t]), d.normalise(dict(items)[i])
            # a space at either end of an occurrence is not in its span
            assert s < t and edits(item, part) <= e + 2
            if not e:
                assert part == item
        if n % 4 == 1:
            at = len(text) - len(text.split(" \u2014 ")[1]) if " \u2014 " in text else 0
            assert any(i == whole[0] and (s, t) == (at, at + len(whole[1])) for i, s, t, _ in found) or not d.normalise(whole[1])


def test_canonical_forms_and_budgets():
    han = "".join(chr(0x4E00 + 91 * i) for i in range(25))
    assert d.search("\u524d\u6587\uff1a\u300c" + han + "\u300d\u3002", d.build([(1, han)])) == [(1, 4, 29, 0)]
    other = "".join(chr(ord(c) + (i % 2)) for i, c in enumerate(han))
    assert d.search(other, d.build([(1, han)])) == []
    word = "a caf\u00e9 na\u00efve r\u00e9sum\u00e9 \u00e0 la carte"
    import unicodedata
    apart = unicodedata.normalize("NFD", word)
    for item, text in ((word, apart), (apart, word)):
        assert d.search(f"x {text.upper()} y", d.build([(1, item)])) == [(1, 2, 2 + len(text), 0)]


def test_ids_with_separators(spark):
    bench = spark.createDataFrame([("a:b,c%", "a passage of several words that is looked for")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "xx a passage of several words that is looked for")], "doc_id long, text string")
    row = d.scan(docs, bench).first()
    assert (row.n_items, row.n_spans, row.spans) == (1, 1, "a%3Ab%2Cc%25:3:48:0")


def test_repetitive_texts_in_steps(monkeypatch):
    items = [(1, "ab " * 120), (2, "xyxyxyxy " * 30 + "end"), (3, "one more thing that is not there at all in this")]
    texts = ["ab " * 700, "xyxyxyxy " * 300, "ab " * 300 + "xyxyxyxy " * 200 + "end"]
    whole = [d.search(t, d.build(items)) for t in texts]
    monkeypatch.setattr(d, "STEP", 500)
    assert [{i for i, *_ in d.search(t, d.build(items))} for t in texts] == [{i for i, *_ in w} for w in whole] == [{1}, {2} & want_of(items, texts[1]), {1, 2}]


def test_very_long_text():
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    item = "the passage that stands near the end of a very long text"
    found = d.search(long + " " + item + " and more", d.build([(5, item)]))
    assert [(i, e) for i, _, _, e in found] == [(5, 0)]


def test_repeated_rows_in_several_passes(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "this is the first passage that is looked for"), (2, "and here is the second passage that is looked for")], "item_id long, text string")
    rows = [(7, "xx this is the first passage that is looked for"), (7, "nothing"), (7, "yy and here is the second passage that is looked for zz"), (None, "this is the first passage that is looked for, and here is the second passage that is looked for"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(repr, d.scan(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 40)
    assert sorted(map(repr, d.scan(docs, bench).collect())) == one
    assert sorted(repr(r.text) for r in d.clean(docs, bench).collect()) == ["'nothing'", "None"]


def test_spans_and_normalisation(spark):
    bench = spark.createDataFrame([(7, "Häuser, die am Fluss stehen; und Gärten, die blühen"), (8, "一二三四五六七八九十 und andere Zeichen hier")], "item_id long, text string")
    texts = ["vorher: HÄUSER DIE am  Fluss\nstehen und Gärten die blühen! nachher", "nichts", "x — 一二三四五六七八九十 und andere Zeichen hier…"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in d.scan(docs, bench).collect()}
    item, s, t, e = got[0].spans.split(":")
    assert (item, e) == ("7", "0") and texts[0][int(s) : int(t)] == "HÄUSER DIE am  Fluss\nstehen und Gärten die blühen"
    assert not got[1].contaminated and got[2].contaminated
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [1]


def test_blocks_of_the_benchmark(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, d.scan(docs, bench).select("doc_id", "contaminated", "n_items").collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, d.scan(docs, bench).select("doc_id", "contaminated", "n_items").collect())) == one
    items = [r.text for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(contaminated or not any(i in texts[doc] for i in items) for doc, contaminated, _ in one)
    assert sum(c for _, c, _ in one) == 200 - d.clean(docs, bench).count()
