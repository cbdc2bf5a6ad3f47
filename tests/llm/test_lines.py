import random

import pytest
import xxhash
from pyspark.sql import functions as F

from memloom.llm import lines

SPACES = " \t\r\v\f"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def changed(text, rng, most):
    text = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abé")
        elif kind == 1 and len(text) > 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abé"))
    return "".join(text)


def tag_of(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(text.encode(), 42) >> 63)


def brute(rows, budgets):
    """Removed positions of each row, judged by rows: a line counts as earlier by (null id last, id, text, position)."""
    listed = sorted({(d is None, d or 0, tag_of(t), p, x.strip(SPACES)) for d, t in rows if t for p, x in enumerate(t.split("\n")) if x.strip(SPACES)})
    first, gone = {}, set()
    for *at, x in listed:
        if first.setdefault(x, at) != at:
            gone.add(tuple(at))
    kept = sorted((at, x) for x, at in first.items())
    for k, (at, x) in enumerate(kept):
        for _, y in kept[:k]:
            edits = max([e for low, e in budgets if min(len(x), len(y)) >= low], default=0)
            if edits and abs(len(x) - len(y)) <= edits and levenshtein(x, y) <= edits:
                gone.add(tuple(at))
                break
    return [sorted(p for *at, p in gone if at == [d is None, d or 0, tag_of(t)]) if t else [] for d, t in rows]


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 14)))
        a, b = sorted((a, changed(a, rng, 5)), key=len)
        pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        for a, b, got in frame.select("a", "b", lines.banded_distance(F.col("a"), F.col("b"), edits)).collect():
            if len(a) > edits:
                want = levenshtein(a, b)
                assert (got == want) if want <= edits else got > edits, (a, b, got, want)


def check(spark, rows, budgets=lines.BUDGETS, texts=False):
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, pos int")
    want = brute(rows, budgets)
    got = sorted(repr((r.doc_id, r.n_removed, r.removed)) for r in lines.report(docs, budgets).collect())
    assert got == sorted(repr((d, len(w), ",".join(map(str, w)))) for (d, _), w in zip(rows, want, strict=True))
    if not texts:
        return
    left = sorted(repr((r.doc_id, r.text)) for r in lines.dedup(docs, budgets).collect())
    assert left == sorted(repr((d, t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in w))) for (d, t), w in zip(rows, want, strict=True))


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 26))) for _ in range(25)]
    rows = [(d, "\n".join(changed(rng.choice(base), rng, 4) for _ in range(rng.randint(1, 12)))) for d in range(40)]
    check(spark, rows, texts=True)
    check(spark, rows, ((3, 1), (9, 2)))


@pytest.mark.parametrize("budgets", [((3, 1), (9, 2)), ((5, 2),)])
def test_full_buckets_are_cut_finer(spark, monkeypatch, budgets):
    monkeypatch.setattr(lines, "FULL", 1)
    monkeypatch.setattr(lines, "COMMON", 1)
    monkeypatch.setattr(lines, "SAMPLE", 2)
    rng = random.Random(8)
    base = ["".join(rng.choice("abé") for _ in range(n)) for n in (4, 7, 10, 18, 31)]
    rows = [(d, "\n".join(changed(rng.choice(base), rng, 5) for _ in range(6))) for d in range(40)]
    check(spark, rows, budgets)


def test_a_large_group_of_near_copies(spark):
    """Lines that differ in many places, and lines that differ in a number: neither kind is paired with its whole group."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(25)]
    rows = []
    for d in range(110):
        some = [rng.choice("xyzuvw") * 4 if rng.random() < 0.06 else w for w in words]
        rows.append((d, " ".join(some) + f"\nThis is page {rng.randrange(10**9)} of the whole long book\nno {rng.randrange(200)} here"))
    check(spark, rows)


def test_odd_rows(spark):
    long = "\n".join(f"line {i * i} of a very long text" for i in range(3000))
    check(spark, [(2, None), (1, ""), (3, "\n \n"), (4, "same line here\nsame line here\n\n"), (5, " same line here\t"), (6, "same lime here"), (None, "same line here"), (7, "x"), (8, "x\nx"), (9, "same line here, once more"), (None, "only here and nowhere else"), (None, None)], texts=True)
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert lines.report(docs, ()).collect()[0].n_removed == 0
    rows = spark.createDataFrame([(3, "one two\nthree four"), (3, "one two\nthree four")], "doc_id long, text string")
    assert [r.n_removed for r in lines.report(rows).collect()] == [0, 0]


def test_different_texts_of_one_id(spark):
    check(spark, [(1, "The very same long line of text"), (2, "The very same long line of text"), (2, "Entirely different words stand here alone")])
    check(spark, [(3, "one line that is long enough\nother"), (3, "two line that is long enough\nother"), (4, "one line that is long enough!"), (4, "two line that is long enouh"), (None, "other"), (None, "others stand alone")])


def test_no_rows(spark):
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_letter_counts_bound_edits_and_tell_lines_of_other_words_apart(spark):
    """Lines that share all but one word are no candidates if more letters differ than the edits can change, whichever letters."""
    rng = random.Random(8)
    letters = "eaontirhsdlcuwy xé"
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(16, 60)))
        pairs.append((a, changed(a, rng, 4)))
    sig = lambda c: lines.signature(F.col(c), F.length(c))
    bound = lambda rows: spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.count_distance(sig("a"), sig("b")).alias("d")).collect()
    assert all(r.d <= 2 * levenshtein(r.a, r.b) for r in bound(pairs))
    assert all(r.d > 4 for r in bound([("on the line stands", "on the line ducally"), ("one two three", "one two three u l d u w c"), ("ssssss in a row", "llllll in a row")]))
