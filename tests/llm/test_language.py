import itertools

import numpy as np

from memloom.llm import language


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        starts = np.zeros(n, bool)
        starts[0] = True
        if n > 4:
            starts[3] = True
        total, want, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[path[i - 1], path[i]] for i in range(1, n) if not starts[i]))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
                if i and not starts[i]:
                    pairs[path[i - 1], y] += p
        gamma, joint = language.forward_backward(scores, starts, moves, pairs=True)
        assert np.allclose(gamma, want / total)
        assert np.allclose(joint, pairs / total)


def test_blocks_do_not_matter():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(1000, 4)), rng.normal(size=(4, 4))
    starts = rng.random(1000) < 0.01
    starts[0] = True
    whole, _ = language.forward_backward(scores, starts, moves)
    cut = np.flatnonzero(starts)
    for a, b in zip(cut, [*cut[1:], 1000], strict=True):
        part, _ = language.forward_backward(scores[a:b], starts[a:b], moves)
        assert np.allclose(whole[a:b], part)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.identify(docs, model, ("doc_id", "lang")).filter(language.held_out(language.F.col("doc_id"))).collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words():
    en, de = "the cat and the house of that man with this thing", "der Hund und das Haus mit einem Mann auf der Straße"
    model = language.fit([(en, "en"), (de, "de")] * 20)
    table = language.letter_table()
    words = language.split_words([f"{en} {de}".lower()], table)
    first = np.zeros(len(words.hashes), bool)
    first[0] = True
    gamma, _ = language.forward_backward(language.emissions(words, model), first, model.moves)
    assert (gamma.argmax(1) == np.repeat([1, 0], [11, 11])).mean() > 0.9
    assert language.predict(["123 !", None, "der Hund"], model, table)[0] == ["und", "und", "de"]


def test_chains_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 64, 700, 1024, 1500):
        scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        starts = rng.random(n) < 0.004
        starts[0] = True
        whole, _ = language.forward_backward(scores, starts, moves)
        monkeypatch.setattr(language, "CHAIN", 256)
        got = np.zeros_like(whole)
        for at, gamma in language.long_marginals(scores, starts, moves):
            got[at : at + len(gamma)] = gamma
        assert np.allclose(got, whole)


def test_runs_of_a_code_switched_text(spark):
    en, de = "the cat and the house of that man with this thing", "der Hund und das Haus mit einem Mann auf der Straße"
    model = language.fit([(en, "en"), (de, "de")] * 20)
    rows = [(1, f"{en}\n{de}"), (2, en), (3, None), (4, "1 2"), (5, f"{de} {en} {de}" * 3000)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[d].runs for d in (1, 2, 3, 4)] == ["en:11,de:11", "en:11", "", ""]
    assert got[5].lang_pred == "de" and sum(int(x.split(":")[1]) for x in got[5].runs.split(",")) == 33 * 3000 - 2999


def test_a_long_text_without_spaces(monkeypatch):
    model = language.fit([("the cat and the house", "en"), ("der Hund und das Haus", "de")] * 20)
    table = language.letter_table()
    text = "\n".join(["der Hund und das Haus"] * 400)
    want = language.predict([text], model, table)
    monkeypatch.setattr(language, "PIECE", 1000)
    assert language.predict([text], model, table) == want
    assert language.predict(["x" * 5000], model, table)[0][0] in ("de", "en")


def test_marks_go_on_with_words():
    import unicodedata

    table = language.letter_table()
    for text, n in (("\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e", 2), ("\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e04\u0e23\u0e31\u0e1a", 1), ("cafe\u0301 au lait", 3), ("\u0301 \u0301\u0301 a1\u0301b", 2), ("\u0301", 0), ("plain words, d'accord", 4)):
        assert len(language.split_words([text], table).starts) == n, unicodedata.normalize("NFD", text)
    two = language.split_words(["a\u0301", "\u0301b"], table)
    assert two.text.tolist() == [0, 1] and len(two.starts) == 2
