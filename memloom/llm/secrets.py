"""Secret scans: fixed base rules, and a character convolutional network over every candidate in its context.

The network (numpy) reads windows of characters over a candidate and around it: one-hot character classes, a layer of
convolutions, the maximum over the candidate and over its context, and a logistic output; a long candidate has several
windows, of which the highest counts. It is trained on labelled findings of all documents: credentials planted into the texts
of each of them, by a generator of many forms, among planted harmless tokens, the documents' own tokens, and the base rules'
findings. The rows are dealt into groups of bounded size; each group fits the same weights on its own rows, and their mean is
what the next round begins with. Rows that are held out calibrate the output (Platt); others set the threshold, the highest
one, in steps of a logit, that recalls ``recall`` of the findings that no base rule makes.
"""

from __future__ import annotations

import binascii
import bisect
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

#: The base rules. Keywords match in either case, ASCII letters only.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
TOKEN_CHARS = frozenset(string.ascii_letters + string.digits + "+/_.=-")
#: What a candidate holds: no word of one kind of letters is one, unless it is very long.
SIGN = re.compile(r"[0-9+/_=]|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z]{24}")
MIN_TOKEN = 8

BEFORE, INSIDE, AFTER = 32, 48, 16
WIDTH, FILTERS, CLASSES = 5, 32, 48

#: Tokens that are planted, at least: as many into each document, and one into each of very many.
PLANTED = 6000
#: Labelled rows, of ten, that fit and that calibrate; the rest set the threshold.
FIT, CALIBRATE = 6, 2
#: Rows of a group, about; a single group makes all its passes at once, of several each makes one in every round.
GROUP_ROWS, PASSES, ROUNDS = 8192, 6, 3
#: Weights are averaged as whole multiples of 1/FIXED, so that the mean does not depend on the order of its terms.
FIXED = 1 << 32
#: Steps of a logit, and the largest one, in which held-out rows are counted.
STEP, LARGEST = 256, 64


def base_findings(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules, by start, then kind in the order of KINDS."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of tokens of MIN_TOKEN characters and more that show one of the signs, without dots and dashes at their ends."""
    out, at = [], 0
    while m := SIGN.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in TOKEN_CHARS:
            start -= 1
        end = at = TOKEN.match(text, start).end()
        while end > start and text[end - 1] in ".-":
            end -= 1
        while start < end and text[start] in ".-":
            start += 1
        if end - start >= MIN_TOKEN:
            out.append((start, end))
    return out


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of sorted disjoint ``spans`` those that overlap none of the sorted spans ``taken``."""
    ends = list(itertools.accumulate((e for _, e in taken), max))
    starts = [s for s, _ in taken]
    return [(s, e) for s, e in spans if not (k := bisect.bisect_left(starts, e)) or ends[k - 1] <= s]


def _classes() -> np.ndarray:
    """Character classes by code point below 256; all others share the last class."""
    table = np.full(257, CLASSES - 1, np.int64)
    for i, c in enumerate(string.ascii_lowercase[:6]):
        table[ord(c)] = i
    for c in string.ascii_lowercase[6:]:
        table[ord(c)] = 6
    for c in "aeiou":
        table[ord(c)] = 7
    for c in string.ascii_uppercase:
        table[ord(c)] = 8
    for c in string.digits:
        table[ord(c)] = 9
    for i, c in enumerate(" \n\"':=+/_.-@<>()[]{},;|&?!#$%*~"):
        table[ord(c)] = 10 + i
    return table


TABLE = _classes()


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Character classes of each INSIDE characters of a candidate, with BEFORE characters before and AFTER behind; 0 pads.

    Windows of a longer candidate overlap by half, and the last ends with it, so each part of it is read whole.
    """
    begins = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    out = []
    for at in begins:
        stop = min(end, at + INSIDE)
        parts = (text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0"), text[at:stop].ljust(INSIDE, "\0"), text[stop : stop + AFTER].ljust(AFTER, "\0"))
        out.append(TABLE[np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), 256)])
    return out


class CharConvNet:
    """Convolution, maxima over what stands before, within and behind the candidate, its mean, logistic output; numpy with Adam."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.15, (WIDTH, CLASSES, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = rng.normal(0, 0.15, 4 * FILTERS + 1)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _layers(self, x: np.ndarray):
        n, length = x.shape
        conv = np.zeros((n, length - WIDTH + 1, FILTERS))
        for w in range(WIDTH):
            conv += self.kernel[w][x[:, w : length - WIDTH + 1 + w]]
        conv = np.maximum(conv + self.bias, 0)
        inside = slice(BEFORE, BEFORE + INSIDE - WIDTH + 1)
        before, within, behind = conv[:, :BEFORE], conv[:, inside], conv[:, inside.stop :]
        # means are over the candidate's own characters: a short one is not diluted by its padding
        own = (x[:, BEFORE : BEFORE + INSIDE - WIDTH + 1] > 0).astype(float)
        own /= np.maximum(own.sum(1, keepdims=True), 1)
        mean = np.einsum("nlf,nl->nf", within, own)
        features = np.concatenate([before.max(1), within.max(1), mean, behind.max(1), np.ones((n, 1))], axis=1)
        # where each maximum stands among all positions
        peaks = (before.argmax(1), BEFORE + within.argmax(1), inside.stop + behind.argmax(1))
        return conv, peaks, own, features

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._layers(x[i : i + 512])[-1] @ self.out for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean log loss, by kernel, bias and output weights."""
        conv, peaks, own, features = self._layers(x)
        delta = (1 / (1 + np.exp(-features @ self.out)) - y) / len(x)
        back = np.zeros_like(conv)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for peak, block in zip(peaks, (0, 1, 3), strict=True):
            np.add.at(back, (rows, peak, cols), delta[:, None] * self.out[block * FILTERS : (block + 1) * FILTERS])
        back[:, BEFORE : BEFORE + INSIDE - WIDTH + 1] += (delta[:, None] * self.out[2 * FILTERS : 3 * FILTERS])[:, None, :] * own[:, :, None]
        back *= conv > 0
        kernel = np.zeros_like(self.kernel)
        flat = back.reshape(-1, FILTERS)
        some = np.flatnonzero(flat.any(1))
        for w in range(WIDTH):
            np.add.at(kernel[w], x[:, w : w + conv.shape[1]].ravel()[some], flat[some])
        return kernel, back.sum((0, 1)), features.T @ delta

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (self.kernel, self.bias, self.out)]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 64):
                part = order[at : at + 64]
                kernel, bias, out = self.gradient(x[part], y[part])
                t += 1
                for (p, m, v), g in zip(state, (kernel, bias, out + 1e-4 * self.out), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def weights(self) -> np.ndarray:
        return np.concatenate([self.kernel.ravel(), self.bias, self.out])

    def load(self, weights: np.ndarray) -> None:
        kernel, self.bias, self.out = np.split(weights.astype(float), [self.kernel.size, self.kernel.size + FILTERS])
        self.kernel = kernel.reshape(self.kernel.shape)

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling on ``n`` rows of logit ``z`` each, apart from those that fit: the probability among such rows, not among all tokens."""
        for _ in range(300 if n.sum() else 0):
            miss = n * (self.probability(z) - y) / n.sum()
            self.scale -= 0.1 * float((miss * z).sum())
            self.shift -= 0.1 * float(miss.sum())

    def constrain(self, z: np.ndarray, n: np.ndarray, recall: float) -> None:
        """The highest threshold that recalls ``recall`` of findings, ``n`` of each logit from ``z`` up to a step more."""
        least = np.minimum(self.probability(z), self.probability(z + 1 / STEP))
        order = np.argsort(-least, kind="stable")
        enough = np.cumsum(n[order]) >= math.ceil(recall * n.sum())
        self.threshold = float(least[order][np.argmax(enough)]) if n.sum() else 1.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.probability(self.logits(x))


def _made_up(rng: random.Random) -> tuple[str, str, int]:
    """(what stands before, token, 1 for a credential) of a made-up token.

    Credentials are a choice of prefix, alphabet, length and joints, or a password of a word, digits and letters in the
    places where passwords stand; harmless ones are names, numbers, dates, paths, addresses and compounds.
    """
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    lower, digits, alnum = string.ascii_lowercase, string.digits, string.ascii_letters + string.digits
    word = lambda: "".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) for _ in range(rng.randint(1, 4))) + rng.choice(("", "n", "s", "r"))
    if rng.random() < 0.5:
        kind = rng.random()
        if kind < 0.7:
            alphabet = rng.choice((alnum, alnum, alnum + "-_", alnum + "+/", "0123456789abcdef", string.ascii_uppercase + digits, lower + digits))
            prefix = rng.choice(("", "", pick(lower, rng.randint(2, 5)) + rng.choice("_-."), pick(string.ascii_uppercase, rng.randint(2, 4)) + rng.choice("_-."), pick(lower, 2) + "_" + pick(lower, 4) + "_"))
            parts = rng.choice((1, 1, 1, 2, 3))
            token = prefix + rng.choice(".-_").join(pick(alphabet, rng.randint(16, 48) if parts == 1 else rng.randint(8, 32)) for _ in range(parts))
            lead = rng.choice(("", "", "key ", "Authorization: Bearer ", "export " + word().upper() + "_KEY=", "credential: ", "use ", "auth=", "x-api " + ": ", "set "))
        else:
            token = rng.choice((word() + pick(digits, rng.randint(1, 4)) + word() + pick(digits, rng.randint(0, 3)), word().capitalize() + rng.choice("_-=+") + pick(alnum, rng.randint(4, 9)), pick(alnum, rng.randint(9, 15)), word() + word().capitalize() + pick(digits, rng.randint(1, 4))))
            lead = rng.choice(("://" + word() + ":", "login " + word() + " / ", "pwd: ", "pass=", "-p ", "sign in with ", "PASS ", "://" + word() + ":"))
        return lead, token, 1
    token = rng.choice((
        lambda: "-".join(word() for _ in range(rng.randint(2, 4))) + "-" + pick(digits, rng.randint(1, 4)),
        lambda: ".".join((word(), word(), rng.choice(("com", "org", "net")))) + "/" + "/".join(word() for _ in range(rng.randint(1, 3))),
        lambda: word() + "." + word() + pick(digits, 2) + "." + rng.choice(("com", "org", "de")),
        lambda: pick(digits, rng.randint(8, 20)),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(("", "T10", "_v2")),
        lambda: word() + word() + rng.choice(("", "_")) + pick(digits, rng.randint(1, 3)),
        lambda: "_".join(word() for _ in range(rng.randint(2, 4))),
        lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(1, 3))),
        lambda: "/".join(word() for _ in range(rng.randint(2, 4))) + rng.choice(("", ".txt", ".html")),
        lambda: word().upper() + "-" + pick(digits, rng.randint(3, 6)),
        lambda: rng.choice("=_-+") * rng.randint(8, 40),
        lambda: ".".join(pick(digits, rng.randint(1, 3)) for _ in range(rng.randint(3, 5))),
        lambda: "+" + pick(digits, 2) + "-" + pick(digits, 3) + "-" + pick(digits, rng.randint(4, 7)),
        lambda: "".join(word() for _ in range(rng.randint(7, 9))),
        lambda: word().upper() + "_" + word().upper(),
    ))()
    return rng.choice(("", "", "", "the ", "see ", "id ", "://", "key ", "no. ", word() + ": ")), token, 0


def planted(text: str, n: int, seed: str) -> list[tuple[list[np.ndarray], int]]:
    """Windows and labels of ``n`` made-up tokens that stand between words of a text."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lead, token, label = _made_up(rng)
        at = rng.randrange(len(text) + 1)
        before, after = text[max(0, at - BEFORE) : at], text[at : at + AFTER]
        before = (before.rsplit(" ", 1)[0] + " " if " " in before else "") + lead
        after = rng.choice((" ", "\n", ". ", '"', "@", "'")) + after
        out.append((windows(before + token + after, len(before), len(before) + len(token)), label))
    return out


def training_rows(docs: DataFrame, each: int) -> DataFrame:
    """Of every document the windows of its base findings (y 1) and of its other tokens (0), and of ``each`` tokens planted into it (own).

    ``deal`` (0 to 9) follows from the window, so equal ones are together on one side of what is held out; ``h`` from the document.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"h": [], "deal": [], "own": [], "y": [], "x": []}
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                base = [(s, e) for s, _, e in base_findings(text)]
                rows = [(False, 1, w) for s, e in base for w in windows(text, s, e)]
                rows += [(False, 0, w) for s, e in apart(candidates(text), base) for w in windows(text, s, e)]
                rows += [(True, y, ws[0]) for ws, y in planted(text, each, f"5:{key}")]
                for i, (own, y, w) in enumerate(rows):
                    x = w.astype(np.uint8).tobytes()
                    values = (binascii.crc32(f"{key}:{i}".encode("utf-8", "replace")), binascii.crc32(x) % 10, own, y, x)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), "h long, deal int, own boolean, y int, x binary", make)


def _array(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, BEFORE + INSIDE + AFTER).astype(np.int64)


def _mean_fit(net: CharConvNet, rows: DataFrame, epochs: int, seed: int) -> np.ndarray:
    """The mean of the weights that each group ``g`` of ``rows(g, h, y, x)`` makes of those of ``net``."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "x", "y"])
        own = CharConvNet()
        own.load(net.weights())
        own.fit(_array(frame["x"].tolist()), frame["y"].to_numpy(float), epochs, seed=seed)
        return pd.DataFrame({"w": [np.rint(own.weights() * FIXED).astype(np.int64)]})

    fitted = rows.groupBy("g").applyInPandas(fit, "w array<long>").select(F.posexplode("w").alias("i", "w"))
    # whole numbers: a sum of decimals cannot overflow, and is the same in any order
    means = fitted.groupBy("i").agg((F.sum(F.col("w").cast("decimal(19,0)")).cast("double") / F.count("*") / F.lit(float(FIXED))).alias("w"))
    return np.array([r.w for r in means.orderBy("i").collect()])


def train(docs: DataFrame, recall: float = 0.95, planted_least: int = PLANTED, group_rows: int = GROUP_ROWS) -> CharConvNet:
    """Fit, calibrate and return the network, from all documents; the threshold recalls ``recall`` of the planted credentials kept for it."""
    net = CharConvNet()
    n = docs.count()
    if not n:
        return net
    rows = materialize(training_rows(docs, -(-planted_least // n)), "secret-rows")
    groups = max(1, -(-rows.filter(F.col("deal") < FIT).count() // group_rows))
    # a group is small and dear, so as many parts as groups are asked for
    dealt = rows.filter(F.col("deal") < FIT).select(F.pmod("h", F.lit(groups)).alias("g"), "h", "y", "x").repartition(groups, "g")
    rounds, epochs = (1, PASSES) if groups == 1 else (ROUNDS, 1)
    for i in range(rounds):
        weights = _mean_fit(net, dealt, epochs, 11 + i)
        if len(weights):
            net.load(weights)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            z = np.clip(net.logits(_array(batch.column("x").to_pylist())), -LARGEST, LARGEST)
            return {"at": np.floor(z * STEP).astype(np.int64)}

        return step

    held = map_rows(rows.filter(F.col("deal") >= FIT), "at long", make, keep=("deal", "own", "y"))
    last = F.col("deal") >= FIT + CALIBRATE
    # at most 2 x LARGEST x STEP counts of each kind
    got = held.filter(~last | F.col("own") & (F.col("y") == 1)).groupBy(last.alias("last"), "y", "at").agg(F.count("*").alias("n")).orderBy("last", "y", "at").collect()
    column = lambda name, part: np.array([r[name] for r in got if r["last"] == part], float)
    net.calibrate((column("at", False) + 0.5) / STEP, column("y", False), column("n", False))
    net.constrain(column("at", True) / STEP, column("n", True), recall)
    return net


def scan(docs: DataFrame, net: CharConvNet) -> DataFrame:
    """Findings in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model.

    A span is kind:start:end in code points, end exclusive. Spans of the network have kind model and overlap no base span.
    Null or empty text: no findings, and the hash of an empty string. Very long texts are scanned whole, their candidates in
    steps. Repeated rows are scanned each. No rows: no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(text: str | None) -> tuple:
            text = text or ""
            base = base_findings(text)
            free = apart(candidates(text), [(s, e) for s, _, e in base])
            added = []
            for at in range(0, len(free), 2048):
                part = free[at : at + 2048]
                read = [windows(text, s, e) for s, e in part]
                score = net.scores(np.array([w for ws in read for w in ws]))
                first = np.cumsum([0] + [len(ws) for ws in read[:-1]])
                best = np.maximum.reduceat(score, first)
                added += [(s, "model", e) for (s, e), p in zip(part, best, strict=True) if p >= net.threshold]
            text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
            counts = [sum(k == kind for _, k, _ in base) for kind in KINDS]
            # the base spans are in order, and an added span never starts with one of them
            return (*counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(sorted(base + added, key=lambda x: (x[0], (*KINDS, "model").index(x[1])))), len(added))

        def step(part: pa.RecordBatch) -> dict:
            rows = [one(t) for t in part.column("text").to_pylist()]
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model")
            return {"doc_id": part.column("doc_id")} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long", make)
