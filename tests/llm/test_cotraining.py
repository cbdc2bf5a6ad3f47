import collections
import math

import numpy as np
import pytest
import regex

from memloom.llm import cotraining as c
from memloom.llm.language import letter_table, split_words


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorers = c.train(docs, labels.filter("doc_id % 5 <> 0"))
    got = c.score(docs, scorers).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality and not r.toxic]
    bad = [r.kept for r in got if not r.quality]
    assert sum(clean) / len(clean) > 0.95
    assert sum(bad) / len(bad) < 0.3


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 1200
    truth = rng.integers(0, 2, n)
    feature = np.where(rng.random(n) < 0.9, truth, 1 - truth) * 10 + rng.integers(0, 5, n)
    entries = (np.arange(n), feature, np.ones(n))
    meta = np.stack([truth * 3 + rng.integers(0, 3, n)] * 4, axis=1)
    y = np.full(n, -1)
    y[:150] = truth[:150]
    scorer = c.cotrain(entries, meta, y, np.arange(n) % 3)
    assert ((scorer.scores(entries, meta) > 0.5) == truth)[150:].mean() > 0.97


def test_content_features_against_a_plain_count():
    """Word counts by bucket, damped and over the root of the length, and eight shapes of each text in bins."""
    texts = ["The cat, the dog; the CAT!", None, "", "  \n", "a b c d e f " * 40, "Straße 12 & #x <b> ?!", "été d́ " + "word " * 6]
    table = letter_table()
    rows, features, values = c.content_rows(texts, table)
    for i, text in enumerate(texts):
        mine = sorted(zip(features[rows == i].tolist(), np.round(values[rows == i], 12).tolist(), strict=True))
        words = [w for w in regex.findall(r"\p{L}[\p{L}\p{Mn}\p{Mc}]*", (text or "").lower())]
        counts = collections.Counter(int(split_words([w], table).hashes[0] % np.uint64(c.BUCKETS)) for w in words)
        distinct = len(counts)
        for k in c.BEGINS:
            start = lambda w: int((split_words([w + "a"], table, (k,)).begins[0, 0] * np.uint64(2 * k + 1) + np.uint64(k)) % np.uint64(c.BUCKETS))  # noqa: B023, E731
            counts.update(start(w) for w in words if len(w) > k)
        want = [(k, round(min(n, 4) / math.sqrt(max(1, len(words))), 12)) for k, n in counts.items()]
        shown = (text or "").encode("latin-1", "replace").decode("latin-1")
        size = max(1, len(shown) - shown.count(" "))
        share = lambda chars: sum(x in chars for x in shown) / size  # noqa: B023, E731
        shapes = [sum("A" <= x <= "Z" for x in shown) / size, sum("0" <= x <= "9" for x in shown) / size, share("#$%&*<>|"), share("!?"), share(",."), distinct / max(1, len(words)), min(1.0, size / max(1, len(words)) / 20), min(1.0, math.log1p(len(words)) / 12)]
        want += [(c.BUCKETS + k * c.BINS + min(c.BINS - 1, int(c.BINS * math.sqrt(min(1.0, s)))), 0.5) for k, s in enumerate(shapes)]
        assert mine == sorted(want), text


@pytest.mark.parametrize("weighed", [False, True])
def test_a_view_is_fitted_like_a_plain_loop(weighed):
    rng = np.random.default_rng(3)
    n, k = 12, 7
    row, feature, value = rng.integers(0, n, 40), rng.integers(0, k, 40), rng.random(40)
    y, weight = rng.integers(0, 2, n).astype(float), rng.choice([0.0, 0.3, 1.0], n)
    view = c.View(np.zeros(k))
    if weighed:
        view.weigh(row, feature, y, weight)
        shares = [[(sum(ff == f and weight[r] > 0 and y[r] == label for r, ff in zip(row, feature, strict=True)) + 1) / (sum((weight > 0) & (y == label)) + 2) for f in range(k)] for label in (1, 0)]
        value = value * np.array([abs(math.log(p / q)) for p, q in zip(*shares, strict=True)])[feature]
    plain = c.View(np.zeros(k))
    plain.fit(row, feature, value, n, y, weight, steps=9)
    if weighed:
        view.fit(row, feature, value / view.worth[feature], n, y, weight, steps=9)
        assert np.allclose(view.weights, plain.weights)
    view = plain
    w, b, sq, sq_b = [0.0] * k, 0.0, [1e-6] * k, 1e-6
    for _ in range(9):
        z = [b + sum(w[f] * v for r, f, v in zip(row, feature, value, strict=True) if r == i) for i in range(n)]
        delta = [weight[i] * (1 / (1 + math.exp(-z[i])) - y[i]) / weight.sum() for i in range(n)]
        for f in range(k):
            g = sum(v * delta[r] for r, ff, v in zip(row, feature, value, strict=True) if ff == f) + 1e-5 * w[f]
            sq[f] += g * g
            w[f] -= 0.3 * g / math.sqrt(sq[f])
        sq_b += sum(delta) ** 2
        b -= 0.3 * sum(delta) / math.sqrt(sq_b)
    assert np.allclose(view.weights, w) and abs(view.bias - b) < 1e-9


def test_held_out_toxicity(spark):
    """Of documents that are labelled toxic, kept from training, most are above the threshold; of the others hardly any."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorers = c.train(docs, labels.filter("doc_id % 5 <> 1"))
    got = c.score(docs, scorers).join(labels.filter("doc_id % 5 = 1"), "doc_id").collect()
    toxic = [r.toxic_score > scorers["toxic"].threshold for r in got if r.toxic]
    clean = [r.toxic_score > scorers["toxic"].threshold for r in got if not r.toxic]
    assert len(toxic) > 5 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) < 0.03, (sum(toxic), len(toxic), sum(clean), len(clean))
