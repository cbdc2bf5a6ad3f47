"""Language of whole texts by a linear-chain conditional random field over words.

Every word (a run of letters) gets scores for each language from hashed features: character bigrams and trigrams
with word ends, prefix, suffix, the word itself, and its presence in learned lexicons. Learned transitions tie
neighbouring words, so code-switched passages come out as runs. Forward-backward gives each word's language
probabilities; a word's label is the most probable language, and a text's language has the greatest sum of them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_rows

#: Labelled documents of each language that the model is fitted on, at most; they are chosen by a hash of doc_id.
TRAIN_DOCS = 150
#: Characters of text that the model is fitted on, at most, shared evenly by the languages; whole texts that fit are taken.
TRAIN_CHARS = 20_000_000
#: Words of each language's lexicon.
LEXICON = 400
BUCKETS = 1 << 15
#: Characters that are scored at a time, and words of one chain in a step of forward-backward (a multiple of BLOCK).
PIECE = 500_000
CHAIN = 1 << 16
BLOCK = 64
SEGMENT = 120
#: Places that are in no word.
NO_LETTER = re.compile(r"[\s\d_]")
#: Languages up to which their table is broadcast.
MOST_LANGS = 10_000


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # score of language j after language i
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of words
    listed: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # scores of each listed word


def letter_table() -> np.ndarray:
    """Whether a code point is a letter: 1, or a mark, which goes on with the word of a letter: 2."""
    kind = lambda c: 1 if c.isalpha() else 2 * (unicodedata.category(c) in ("Mn", "Mc"))
    return np.fromiter((kind(chr(i)) for i in range(0x110000)), np.uint8, 0x110000)


def in_words(kinds: np.ndarray) -> np.ndarray:
    """Which places of a text stand in words: letters, and marks behind a letter or behind such a mark."""
    letter, mark = kinds == 1, kinds == 2
    if not mark.any():
        return letter
    # the last place before each that is no mark decides
    last = np.maximum.accumulate(np.where(mark, 0, np.arange(len(kinds))))
    return letter | mark & letter[last]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of one or several texts: feature buckets of their letters and of themselves, and their hashes."""

    starts: np.ndarray  # of each word among the letters
    letters: np.ndarray  # 2 x letters: bigram and trigram buckets
    whole: np.ndarray  # 3 x words: prefix, suffix and word buckets
    hashes: np.ndarray
    text: np.ndarray  # index of each word's text
    begins: np.ndarray  # hashes of the first letters of each word, a row for each number of letters; 0 for shorter words


def split_words(texts: list[str], table: np.ndarray, begins: tuple[int, ...] = ()) -> Words:
    """All words of ``texts`` in order, without a Python loop over them; ``begins`` are numbers of letters to hash by themselves."""
    codes = np.frombuffer(" ".join(texts).join("  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = in_words(table[codes])
    c = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    first = ~letter[at - 1]
    starts = np.flatnonzero(first)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64), np.zeros(0, np.uint64), none, np.zeros((len(begins), 0), np.uint64))
    before, here, after = c[at - 1], c[at], c[at + 1]
    bigram = _mix(before * np.uint64(0x1F123BB5) + here * np.uint64(0x5851F42D) + np.uint64(1))
    trigram = _mix(bigram + after * np.uint64(0x2545F491) + np.uint64(2))
    word = np.cumsum(first) - 1
    place = (np.arange(len(at)) - starts[word]).astype(np.uint64)
    placed = _mix(here + (place << np.uint64(24)))
    hashes = np.add.reduceat(placed, starts)
    s = at[starts]
    lengths = np.diff(np.append(starts, len(at)))
    e = s + lengths - 1
    # beyond a word's end stands 0 or the next word, which the end hides
    second, third = np.where(lengths > 1, c[s + 1], 0), np.where(lengths > 2, c[np.minimum(s + 2, len(c) - 1)], 0)
    prefix = _mix(c[s] * np.uint64(0x27BB2EE6) + second * np.uint64(0x1B873593) + third * np.uint64(0x6C8E9CF5) + np.uint64(3))
    last2, last3 = np.where(lengths > 1, c[e - 1], 0), np.where(lengths > 2, c[e - 2], 0)
    suffix = _mix(c[e] * np.uint64(0x27BB2EE6) + last2 * np.uint64(0x1B873593) + last3 * np.uint64(0x6C8E9CF5) + np.uint64(4))
    bucket = lambda x: (x % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.searchsorted(ends, s - 1, side="right")
    first_letters = [np.where(lengths > k, np.add.reduceat(np.where(place < k, placed, np.uint64(0)), starts), np.uint64(0)) for k in begins]
    return Words(starts, np.stack([bucket(bigram), bucket(trigram)]), np.stack([bucket(prefix), bucket(suffix), bucket(_mix(hashes))]), hashes, owner, np.array(first_letters, np.uint64).reshape(len(begins), len(starts)))


def emissions(words: Words, model: Crf) -> np.ndarray:
    """Score of each language for each word."""
    if not len(words.starts):
        return np.zeros((0, len(model.langs)), np.float32)
    w = model.weights
    out = np.add.reduceat(w[words.letters[0]] + w[words.letters[1]], words.starts, axis=0)
    out += w[words.whole[0]] + w[words.whole[1]] + w[words.whole[2]]
    if len(model.lexicon):
        k = np.minimum(np.searchsorted(model.lexicon, words.hashes), len(model.lexicon) - 1)
        out += np.where((model.lexicon[k] == words.hashes)[:, None], model.listed[k], 0)
    return out


def long_marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray):
    """(first word, marginals) of each CHAIN words, the last first: one exact chain, of which a part is in memory at a time.

    A pass forward keeps what enters each part, a pass backward fills the parts in.
    """
    cuts = list(range(0, len(scores), CHAIN))
    enter: list[np.ndarray | None] = [None]
    for at in cuts[:-1]:
        enter.append(_forward(scores[at : at + CHAIN], starts[at : at + CHAIN], moves, enter[-1]))
    leave = None
    for at, v in zip(reversed(cuts), reversed(enter), strict=True):
        gamma, _, leave = forward_backward(scores[at : at + CHAIN], starts[at : at + CHAIN], moves, False, v, leave, True)
        yield at, gamma


def _forward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, v: np.ndarray | None) -> np.ndarray:
    """Forward probabilities after a part, whose length is a multiple of BLOCK, from those before it."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True)).reshape(-1, BLOCK, k)
    fresh = starts.copy()
    fresh[0] |= v is None
    fresh = fresh.reshape(-1, BLOCK)
    move = np.exp(moves - moves.max())
    whole = np.broadcast_to(np.eye(k), (len(e), k, k)).copy()
    for s in range(BLOCK):
        whole = np.matmul(whole, np.where(fresh[:, s, None, None], 1.0, move[None])) * e[:, s, None, :]
        whole /= whole.sum((1, 2), keepdims=True)
    v = np.ones(k) if v is None else v
    for m in whole:
        v = v @ m
        v /= v.sum()
    return v


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None, edge: bool = False):
    """Marginals of each word, and with ``pairs`` the expected number of moves from language to language.

    ``starts`` marks words that begin a text; no transition leads into them. The chain is cut into blocks: their
    transfer matrices are multiplied for all blocks at once, then the blocks are linked, then filled in. A part of a
    longer chain gets the forward probabilities ``before`` it and the backward ones ``after`` it (its length is then a multiple
    of BLOCK), and with ``edge`` returns the backward ones at its beginning as well.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    size = -(-n // BLOCK) * BLOCK
    e = np.ones((size, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    fresh = np.ones(size, bool)
    fresh[:n] = starts
    fresh[0] |= before is None
    e, fresh = e.reshape(-1, BLOCK, k), fresh.reshape(-1, BLOCK)
    move = np.exp(moves - moves.max())
    blocks = len(e)
    step = lambda s: np.where(fresh[:, s, None, None], 1.0, move[None])
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for s in range(BLOCK):
        whole = np.matmul(whole, step(s)) * e[:, s, None, :]
        whole /= whole.sum((1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.ones(k) if before is None else before
    for b in range(blocks):
        into[b] = v
        v = v @ whole[b]
        v /= v.sum()
    v = np.ones(k) if after is None else after
    for b in range(blocks - 1, -1, -1):
        out[b] = v
        v = whole[b] @ v
        v /= v.sum()
    alpha, beta = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK, k))
    v = into
    for s in range(BLOCK):
        v = np.where(fresh[:, s, None], v.sum(1, keepdims=True), v @ move) * e[:, s]
        v /= v.sum(1, keepdims=True)
        alpha[:, s] = v
    v = out
    for s in range(BLOCK - 1, -1, -1):
        beta[:, s] = v
        v = v * e[:, s]
        v = np.where(fresh[:, s, None], v.sum(1, keepdims=True), v @ move.T)
        v /= v.sum(1, keepdims=True)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if not pairs:
        return (gamma, None, v[0]) if edge else (gamma, None)
    inner = np.flatnonzero(~starts[1:]) + 1
    joint = alpha[inner - 1][:, :, None] * move[None] * (e.reshape(-1, k)[:n][inner] * beta[inner])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return gamma, joint.sum(0)


def fit(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.1, seed: int = 3) -> Crf:
    """Model of (text, language) samples by stochastic gradients on the conditional likelihood (AdaGrad).

    Besides the texts themselves, runs of words of several languages are strung together, which teaches transitions.
    """
    langs = sorted({lang for _, lang in samples})
    k = len(langs)
    model = Crf(langs, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    if k < 2:
        return model
    rng, table = np.random.default_rng(seed), letter_table()
    sequences = [(text.lower(), None, langs.index(lang)) for text, lang in samples]
    counts: list[dict[int, int]] = [{} for _ in langs]
    split = [[w for w in text.split() if any(map(str.isalpha, w))] for text, _, _ in sequences]
    for (_, _, y), words in zip(sequences, split, strict=True):
        for h, c in zip(*np.unique(split_words([" ".join(words)], table).hashes, return_counts=True), strict=True):
            counts[y][int(h)] = counts[y].get(int(h), 0) + int(c)
    total = [max(1, sum(c.values())) for c in counts]
    names = sorted({h for c in counts for h in sorted(c, key=lambda h: (-c[h], h))[:LEXICON]})
    model.lexicon = np.array(names, np.uint64)
    # smoothed log shares, a start value that training corrects
    shares = np.array([[np.log((c.get(h, 0) + 0.5) / (t + 1)) for c, t in zip(counts, total, strict=True)] for h in names], np.float32)
    model.listed = 0.2 * (shares - shares.mean(1, keepdims=True))
    # runs of up to SEGMENT words, so that no long text fills a batch with one language
    runs = [(" ".join(words[at : at + SEGMENT]), y) for (_, _, y), words in zip(sequences, split, strict=True) for at in range(0, len(words), SEGMENT)]
    order = rng.permutation(len(runs))
    batches: list[list[tuple[list[str], list[int]]]] = [[]]
    for i in order:
        mixed, labels = [], []
        for _ in range(4):  # four runs of up to 30 words from four texts
            j = int(rng.integers(len(split)))
            if split[j]:
                at = int(rng.integers(len(split[j])))
                mixed.append(" ".join(split[j][at : at + int(rng.integers(5, 30))]))
                labels.append(sequences[j][2])
        batches[-1] += [([runs[i][0]], [runs[i][1]]), (mixed, labels)]
        if sum(len(p) for s, _ in batches[-1] for p in s) > 80_000:
            batches.append([])
    g_weights, g_moves = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    g_listed = np.full_like(model.listed, 1e-6)
    prepared = []
    for batch in filter(None, batches):
        words = split_words([p for parts, _ in batch for p in parts], table)
        label = np.array([y for _, labels in batch for y in labels])[words.text]
        sequence = np.repeat(np.arange(len(batch)), [len(p) for p, _ in batch])[words.text]
        prepared.append((words, label, np.append(True, sequence[1:] != sequence[:-1])))
    for _ in range(epochs):
        for words, label, first in prepared:
            n = len(label)
            if not n:
                continue
            gamma, joint = forward_backward(emissions(words, model), first, model.moves, pairs=True)
            delta = gamma
            delta[np.arange(n), label] -= 1
            inner = np.flatnonzero(~first[1:]) + 1
            np.subtract.at(joint, (label[inner - 1], label[inner]), 1)
            per_letter = np.repeat(delta, np.diff(np.append(words.starts, words.letters.shape[1])), axis=0)
            grad = np.empty_like(model.weights)
            for y in range(k):
                grad[:, y] = sum(np.bincount(f, per_letter[:, y], BUCKETS) for f in words.letters) + sum(np.bincount(f, delta[:, y], BUCKETS) for f in words.whole)
            at = np.minimum(np.searchsorted(model.lexicon, words.hashes), len(model.lexicon) - 1)
            hit = model.lexicon[at] == words.hashes
            listed = np.stack([np.bincount(at[hit], delta[hit, y], len(model.lexicon)) for y in range(k)], axis=1)
            for value, g, square in ((model.weights, grad / n + 1e-7 * model.weights, g_weights), (model.moves, joint / n, g_moves), (model.listed, listed / n, g_listed)):
                square += g * g
                value -= (rate * g / np.sqrt(square)).astype(value.dtype)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's language is kept from training; null ids are not used in either way."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Crf:
    """Fit on whole texts of at most about ``max_docs`` documents of each language, none of them held out, within TRAIN_CHARS."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a share of each language by hash leaves max_docs on average; 1.2 times that many can come, not more
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n")).alias("share"))
    n_langs = sizes.count()
    rows = known.join(F.broadcast(share) if n_langs <= MOST_LANGS else share, "lang").filter(key < F.col("share") * (1 << 30)).select("lang", "text", "doc_id", key.alias("key"))
    budget = TRAIN_CHARS // max(1, n_langs)
    order = Window.partitionBy("lang").orderBy("key", "doc_id", "text")
    rows = rows.filter(F.length("text") <= budget // 4).withColumn("at", F.row_number().over(order)).withColumn("chars", F.sum(F.length("text")).over(order))
    rows = rows.filter((F.col("at") <= int(1.2 * max_docs)) & (F.col("chars") <= budget)).orderBy("key", "doc_id", "text").collect()
    return fit([(r.text, r.lang) for r in rows])


def label_runs(labels: np.ndarray, own: np.ndarray, langs: list[str], n: int) -> list[str]:
    """For each of ``n`` texts its runs of words of one label: lang:words, comma-joined; ``own`` is the text of each word."""
    out: list[list[str]] = [[] for _ in range(n)]
    if len(labels):
        first = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (own[1:] != own[:-1])))
        for i, y, size in zip(own[first].tolist(), labels[first].tolist(), np.diff(np.append(first, len(labels))).tolist(), strict=True):
            out[i].append(f"{langs[y]}:{size}")
    return [",".join(x) for x in out]


def predict(texts: list[str | None], model: Crf, table: np.ndarray) -> tuple[list[str], list[float], list[str]]:
    """Language and score (the language's share of the words' probabilities) of each whole text, and its runs of labels."""
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
    sums = np.zeros((len(texts), len(model.langs)))
    runs = [""] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        pieces, owner = [], []
        for i in group:
            text = texts[i].lower()
            at = 0
            while at < len(text):
                end = at + PIECE  # any place between words; in a word of that many letters, inside it
                if end < len(text):
                    m = NO_LETTER.search(text, end, end + PIECE)
                    end = m.start() if m else end
                pieces.append(text[at:end])
                owner.append(i)
                at = end
        scores, firsts, owners, at = [], [], [], 0
        while at < len(pieces):  # scores in pieces of bounded size, one chain for each text
            stop, held = at + 1, len(pieces[at])
            while stop < len(pieces) and held + len(pieces[stop]) <= PIECE:
                held += len(pieces[stop])
                stop += 1
            words = split_words(pieces[at:stop], table)
            scores.append(emissions(words, model))
            owners.append(np.array(owner[at:stop], np.int64)[words.text])
            at = stop
        if not scores:
            return
        own = np.concatenate(owners)
        if not len(own):
            return
        firsts = np.append(True, own[1:] != own[:-1])
        labels = np.empty(len(own), np.int64)
        for at, gamma in long_marginals(np.concatenate(scores), firsts, model.moves):
            part = slice(at, at + len(gamma))
            labels[part] = gamma.argmax(1)
            for y in range(len(model.langs)):
                sums[:, y] += np.bincount(own[part], gamma[:, y], len(texts))
        for i, r in enumerate(label_runs(labels, own, model.langs, len(texts))):
            runs[i] = r or runs[i]

    for i, text in enumerate(texts):
        if not text:
            continue
        if group and size + len(text) > PIECE:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        flush()
    words = sums.sum(1)
    best = sums.argmax(1)
    langs = [model.langs[b] if n > 0 else "und" for b, n in zip(best, words, strict=True)]
    return langs, [float(min(1.0, sums[i, b] / n)) if n > 0 else 0.0 for i, (b, n) in enumerate(zip(best, words, strict=True))], runs


def identify(docs: DataFrame, model: Crf, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score and runs for every whole text.

    runs are the word labels: lang:words for each run of words of one language, comma-joined, in order. Null text or text
    without letters: ``und`` with score 0 and no runs; so is everything if nothing could be learned. Texts of any length
    are one chain each, worked through in parts. Repeated rows are labelled each. No rows: no rows. Other columns are ignored.
    """
    inputs = list(dict.fromkeys([*keep, "text"]))

    def make():
        table = letter_table()

        def step(part: pa.RecordBatch) -> dict:
            langs, scores, runs = predict(part.column("text").to_pylist(), model, table)
            return {"lang_pred": langs, "score": scores, "runs": runs}

        return step

    return map_rows(docs.select(*inputs), "lang_pred string, score double, runs string", make, keep=keep)
