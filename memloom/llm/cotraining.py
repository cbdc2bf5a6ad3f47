"""Quality classifier by co-training two views of a document.

The content view reads hashed words, beginnings of words and shape statistics of the whole text, each the more the labels differ
where it occurs; the metadata view reads source, language and length. Both are logistic models fitted on labelled documents. In each round every view labels the documents of
an unlabelled pool it is most sure of, and these pseudo-labels train the other view. Each view is calibrated, and both
are combined by a logistic model of their calibrated outputs, which scores all documents. Labelled documents are dealt, equal
texts together, into four parts: to train, to calibrate, to combine, and to set the threshold.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .language import letter_table, split_words

#: Labelled documents and documents of the unlabelled pool that the views are fitted on, at most, chosen by hash.
TRAIN_DOCS = 4000
POOL_DOCS = 2000
BUCKETS = 1 << 15
STATS, BINS = 8, 16
META = 256
ROUNDS = 3
#: Labelled documents, of twenty, that train, calibrate, combine and set the threshold.
DEAL = (10, 3, 3, 4)
#: Letters at the beginning of longer words that are features of their own: words that are made of one stem share them.
BEGINS = (5, 7)
#: Share of clean held-out documents that a threshold may reject.
MAX_REJECTED = 0.01


def content_rows(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) entries of the content view, sorted by row."""
    lowered = [(t or "").lower() for t in texts]
    words = split_words(lowered, table, BEGINS)
    n = np.bincount(words.text, minlength=len(texts))
    bucket = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
    whole = words.text * BUCKETS + bucket(words.hashes)
    distinct = np.bincount(np.unique(whole) // BUCKETS, minlength=len(texts))
    # the beginnings of words fall on the same buckets by another hash
    begun = [(words.text * BUCKETS + bucket(h * np.uint64(2 * k + 1) + np.uint64(k)))[h > 0] for k, h in zip(BEGINS, words.begins, strict=True)]
    key, counts = np.unique(np.concatenate([whole, *begun]), return_counts=True)
    row = key // BUCKETS
    value = np.minimum(counts, 4) / np.sqrt(np.maximum(n[row], 1))
    shapes = np.zeros((len(texts), STATS))
    for i, text in enumerate(texts):
        data = np.bincount(np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8), minlength=256)
        size = max(1, int(data.sum()) - int(data[32]))
        shapes[i] = (data[65:91].sum() / size, data[48:58].sum() / size, data[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / size, data[[33, 63]].sum() / size, data[[44, 46]].sum() / size, distinct[i] / max(1, n[i]), min(1.0, size / max(1, n[i]) / 20), min(1.0, math.log1p(n[i]) / 12))
    bins = np.minimum(BINS - 1, (BINS * np.sqrt(np.minimum(shapes, 1))).astype(np.int64))
    rows = np.concatenate([row, np.repeat(np.arange(len(texts)), STATS)])
    features = np.concatenate([key % BUCKETS, (BUCKETS + np.arange(STATS) * BINS + bins).ravel()])
    values = np.concatenate([value, np.full(len(texts) * STATS, 0.5)])
    order = np.argsort(rows, kind="stable")
    return rows[order], features[order], values[order]


def meta_rows(part: pa.RecordBatch) -> np.ndarray:
    """Four hashed features for each document: source, language, length step, and source with length step."""
    size = part.column("meta_size").to_numpy(zero_copy_only=False)
    return np.stack([part.column(f"meta_{k}").to_numpy(zero_copy_only=False) for k in ("source", "lang")] + [size, part.column("meta_both").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def with_metadata(docs: DataFrame) -> DataFrame:
    """``docs`` with hashed metadata in place of source, lang and n_chars; null is a value of its own."""
    step = F.coalesce(F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)), F.lit(-1))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(META)).cast("long")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return docs.select("doc_id", "text", bucket(F.lit("s"), source).alias("meta_source"), bucket(F.lit("l"), lang).alias("meta_lang"), bucket(F.lit("n"), step).alias("meta_size"), bucket(F.lit("b"), source, step).alias("meta_both"))


@dataclass
class View:
    """A logistic model with a calibrated output: weights, how much each feature counts, and scale and shift of its logit."""

    weights: np.ndarray
    bias: float = 0.0
    worth: np.ndarray | None = None
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, self.weights[feature] * self._worth(feature, value), n) + self.bias

    def _worth(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value if self.worth is None else value * self.worth[feature]

    def weigh(self, row: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Let a feature count as much as the labels differ where it occurs: the log ratio of its shares in rows of either label."""
        size = len(self.weights)
        shares = []
        for label in (1, 0):
            rows = (weight > 0) & (y == label)
            shares.append((np.bincount(feature, rows[row], size) + 1) / (rows.sum() + 2))
        self.worth = np.abs(np.log(shares[0] / shares[1]))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return self.scale * z + self.shift

    def fit(self, row, feature, value, n: int, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.3) -> None:
        square, square_bias = np.full_like(self.weights, 1e-6), 1e-6
        for _ in range(steps):
            delta = weight * (_sigmoid(self.logits(row, feature, value, n)) - y) / max(1e-9, weight.sum())
            g = np.bincount(feature, self._worth(feature, value) * delta[row], len(self.weights)) + 1e-5 * self.weights
            square += g * g
            self.weights -= rate * g / np.sqrt(square)
            square_bias += delta.sum() ** 2
            self.bias -= rate * delta.sum() / math.sqrt(square_bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Coefficients of a small logistic model by Newton steps, the last one for a constant; slightly shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Scorer:
    """Both views, their combination and the threshold for one label."""

    content: View
    meta: View
    mix: np.ndarray
    threshold: float = 0.5

    def scores(self, entries, meta: np.ndarray) -> np.ndarray:
        n = len(meta)
        own = self.content.calibrated(self.content.logits(*entries, n))
        other = self.meta.calibrated(self.meta.logits(np.repeat(np.arange(n), meta.shape[1]), meta.ravel(), np.full(meta.size, 0.5), n))
        return _sigmoid(np.column_stack([own, other, np.ones(n)]) @ self.mix)


def cotrain(entries, meta: np.ndarray, y: np.ndarray, part: np.ndarray, rounds: int = ROUNDS, per_round: float = 0.1) -> Scorer:
    """Fit both views on ``y`` (1, 0, or -1: unlabelled) of rows in part 0; part 1 calibrates them, part 2 combines them.

    In each round a view hands over at most ``per_round`` of the pool on each side of its boundary, in the ratio of
    the labels, and only where it is at least 90% sure.
    """
    n = len(y)
    m_entries = (np.repeat(np.arange(n), meta.shape[1]), meta.ravel(), np.full(meta.size, 0.5))
    sides = [(View(np.zeros(BUCKETS + STATS * BINS)), entries), (View(np.zeros(META)), m_entries)]
    train, pool = (y >= 0) & (part == 0), y < 0
    use = lambda k: (chosen := (y >= 0) & (part == k)).any() and len(set(y[chosen].tolist())) > 1
    share = float(np.clip(y[train].mean() if train.any() else 0.5, 0.02, 0.98))
    sides[0][0].weigh(entries[0], entries[1], y, train)
    targets = [np.where(train, y, 0.5).astype(float) for _ in sides]
    weights = [train.astype(float) for _ in sides]
    for turn in range(rounds + 1):
        sure = []
        for k, (view, rows) in enumerate(sides):
            if turn == 0 or weights[k][pool].any():
                view.fit(*rows, n, targets[k], weights[k], steps=60 if turn == 0 else 30)
            z = view.logits(*rows, n)
            if use(1):
                hold = (y >= 0) & (part == 1)
                view.scale, view.shift = logistic(z[hold, None], y[hold])
            sure.append(_sigmoid(view.calibrated(z)))
        if turn == rounds or not pool.any():
            break
        for k, p in enumerate(sure):
            other = 1 - k
            for label, of, ranked in ((1, share, p), (0, 1 - share, 1 - p)):
                free = np.flatnonzero(pool & (weights[other] == 0) & (ranked >= 0.9))
                best = free[np.argsort(-ranked[free], kind="stable")][: int(per_round * of * pool.sum())]
                targets[other][best] = label
                weights[other][best] = 0.3
    z = np.column_stack([view.calibrated(view.logits(*rows, n)) for view, rows in sides])
    hold = (y >= 0) & (part == 2)
    mix = logistic(z[hold], y[hold]) if use(2) else np.array([1.0, 0.0, 0.0])
    return Scorer(sides[0][0], sides[1][0], mix)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, pool_docs: int = POOL_DOCS) -> dict[str, Scorer]:
    """Scorers for quality and toxic, fitted on samples by hash of at most about ``max_docs`` labelled and ``pool_docs`` other documents."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    key = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    n_known, n_docs = known.count(), docs.count()
    # about max_docs rows, whatever the input: small enough to be sent to every executor
    some = known.filter(key < F.lit(int((1 << 30) * min(1.0, max_docs / max(1, n_known)))))
    pool_key = key < F.lit(int((1 << 30) * min(1.0, pool_docs / max(1, n_docs))))
    labelled = with_metadata(docs).join(F.broadcast(some), "doc_id").withColumn("_pool", F.lit(False))
    pool = with_metadata(docs.filter(pool_key & F.col("doc_id").isNotNull())).join(known.select("doc_id"), "doc_id", "left_anti").withColumn("quality", F.lit(-1)).withColumn("toxic", F.lit(-1)).withColumn("_pool", F.lit(True))
    rows = labelled.unionByName(pool).select("doc_id", "text", "meta_source", "meta_lang", "meta_size", "meta_both", "quality", "toxic")

    def make():
        table = letter_table()

        def step(part: pa.RecordBatch) -> dict:
            row, feature, value = content_rows(part.column("text").to_pylist(), table)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return {"doc_id": part.column("doc_id").cast(pa.int64()), "f": [feature[a:b].astype(np.uint16).tobytes() for a, b in spans], "v": [value[a:b].astype(np.float32).tobytes() for a, b in spans], "m": meta_rows(part).tolist(), "quality": part.column("quality").cast(pa.int32()), "toxic": part.column("toxic").cast(pa.int32())}

        return step

    got = map_rows(rows, "doc_id long, f binary, v binary, m array<long>, quality int, toxic int", make).collect()
    got.sort(key=lambda r: (r.doc_id, r.f))
    sizes = np.array([len(r.f) // 2 for r in got], np.int64)
    entries = (np.repeat(np.arange(len(got)), sizes), np.concatenate([np.frombuffer(r.f, np.uint16) for r in got] + [np.zeros(0, np.uint16)]).astype(np.int64), np.concatenate([np.frombuffer(r.v, np.float32) for r in got] + [np.zeros(0, np.float32)]).astype(float))
    meta = np.array([r.m for r in got], np.int64).reshape(len(got), 4)
    # equal texts have equal features and fall into the same part
    part = np.searchsorted(np.cumsum(DEAL), [zlib.crc32(r.f + r.v) % sum(DEAL) for r in got], side="right")
    out = {}
    for name in ("quality", "toxic"):
        y = np.array([-1 if getattr(r, name) is None else getattr(r, name) for r in got], np.int64)
        scorer = cotrain(entries, meta, y, part)
        scores = scorer.scores(entries, meta)
        clean = (part == 3) & (y == (name == "quality"))
        if clean.any():
            least, most = np.quantile(scores[clean], [MAX_REJECTED, 1 - MAX_REJECTED])
            scorer.threshold = float(min(0.5, least) if name == "quality" else max(0.5, most))
        out[name] = scorer
    return out


def score(docs: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """doc_id, quality_score, toxic_score (0 to 1) and kept for every whole text.

    kept: quality at or above its threshold, and toxicity at or below its own. Null or empty text: scored by its
    metadata and shape. Very long texts are read whole. Null metadata: a value of its own. Repeated rows are scored each. No
    labels: every score is that of an untrained model, and everything is kept. No rows: no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        table = letter_table()

        def step(part: pa.RecordBatch) -> dict:
            entries, meta = content_rows(part.column("text").to_pylist(), table), meta_rows(part)
            quality, toxic = (scorers[k].scores(entries, meta) for k in ("quality", "toxic"))
            kept = (quality >= scorers["quality"].threshold) & (toxic <= scorers["toxic"].threshold)
            return {"doc_id": part.column("doc_id"), "quality_score": quality.tolist(), "toxic_score": toxic.tolist(), "kept": kept.tolist()}

        return step

    return map_rows(with_metadata(docs), f"doc_id {kind}, quality_score double, toxic_score double, kept boolean", make, rows=128)
