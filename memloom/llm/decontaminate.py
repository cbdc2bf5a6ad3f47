"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case, composed, runs of other than letters, marks and digits made one space)
and cut into q-grams of code points. An item within ``k`` edits of a part of a text shares at least ``len - q + 1 - k q`` q-grams with it, on
diagonals that differ by at most ``k``. Shared q-grams are counted in overlapping bands of diagonals; regions that
meet the bound are verified by an alignment within the band. Items too short for the bound at q = 8 have q = 4; those
too short for an edit are looked for as whole words.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, packed, unpacked

#: Lengths of q-grams: the first at which an item's edits leave a bound of one shared q-gram at least.
QS = (8, 4)
#: Edits that an occurrence may have, as a share of the item's normalised length.
ERROR_RATE = 0.1
#: Characters of benchmark text that are searched for in one pass; a larger benchmark takes several passes.
BLOCK_CHARS = 2_000_000
FILTER_BITS = 22
#: Shared q-grams that are looked at in one step; text and item can both repeat themselves, so there can be any number.
STEP = 1_000_000
#: Letters and digits of Latin-1 stay, all other bytes become spaces.
LETTERS = bytes(b if chr(b).isalnum() else 32 for b in range(256))


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter, a digit, or a mark, which belongs to the letter before it."""
    return np.fromiter((chr(i).isalnum() or unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """The code points of a text, a byte each where Latin-1 has them all."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def composed(text: str) -> str:
    """Lower case in composed form."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text.lower())


def normalise(text: str) -> str:
    """Lower-case composed words joined by spaces: a code point for each letter, mark and digit."""
    text = composed(text)
    points = codes(text)
    if points.dtype == np.uint8:
        return b" ".join(points.tobytes().translate(LETTERS).split()).decode("latin-1")
    plain = np.where(letter_table()[points], points, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass")
    return " ".join(w for w in plain.split(" ") if w)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A number for the q-gram at each position, the same for the same code points; q is 8 or 4.

    A q-gram of Latin-1 is its bytes. Other code points are mixed first, so two q-grams may share a number: that lets more
    through to the alignment and nothing less.
    """
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    if data.dtype == np.uint8:
        raw = data.tobytes()
        for o in range(min(q, n)):
            out[o::q] = np.frombuffer(raw, f"u{q}", (n - o + q - 1) // q, o)
        return out
    wide = data.astype(np.uint64)
    mixed = np.where(wide < 256, wide, wide * np.uint64(0x9E3779B97F4A7C15) ^ (wide >> np.uint64(3)))
    for j in range(q):
        out += mixed[j : j + n] << np.uint64(8 * j)
    return out


def slots(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Index:
    """Items of one block and one q with a sorted list of their q-grams and a bit filter over it."""

    q: int
    ids: list
    items: list[str]
    points: list[np.ndarray]  # code points of each item
    edits: np.ndarray  # allowed edits of each item
    bound: np.ndarray  # least number of shared q-grams
    known: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where the entries of each begin, and the end
    item: np.ndarray  # of each entry
    offset: np.ndarray  # of each entry in its item
    filter: np.ndarray


@dataclass
class Words:
    """Items without an edit to spare, found as whole words only."""

    ids: list
    items: list[str]


def build(rows: list[tuple], rate: float = ERROR_RATE) -> list[Index | Words]:
    """Indexes of (item_id, text) rows. Items without letters or digits are never found."""
    kept = [(i, data) for i, data in ((i, normalise(t or "")) for i, t in rows) if data]
    by: dict[int, list[tuple]] = {}
    for i, data in kept:
        k = int(rate * len(data))
        by.setdefault(next((q for q in QS if k and len(data) - q + 1 - k * q >= 1), 0), []).append((i, data))
    out: list[Index | Words] = [_index(by[q], q, rate) for q in QS if q in by]
    if 0 in by:
        out.append(Words([i for i, _ in by[0]], [d for _, d in by[0]]))
    return out


def _index(kept: list[tuple], q: int, rate: float) -> Index:
    sizes = np.array([len(d) for _, d in kept], np.int64)
    edits = (rate * sizes).astype(np.int64)
    points = [codes(d) for _, d in kept]
    all_grams = [grams(p, q) for p in points]
    gram = np.concatenate(all_grams)
    item = np.repeat(np.arange(len(kept)), [len(g) for g in all_grams])
    offset = np.concatenate([np.arange(len(g)) for g in all_grams]).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slots(gram)] = True
    known, first = np.unique(gram[order], return_index=True)
    return Index(q, [i for i, _ in kept], [d for _, d in kept], points, edits, sizes - q + 1 - edits * q, known, np.append(first, len(gram)), item[order], offset[order], bits)


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int]:
    """Least edits of ``item`` against a part of ``text`` on diagonals low..high: (edits, start, end); k + 1 if none has k.

    Cells hold edits and the start of their part; a row is one array operation, with insertions along the row by a running minimum.
    """
    width = high - low + 1
    big = 1 << 20
    diagonals = np.arange(low, high + 1)
    steps = np.arange(width)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, big).astype(np.int64)
    start = diagonals.copy()  # free start anywhere in the band
    for i, c in enumerate(item.tolist(), 1):
        at = diagonals + i - 1  # character that a diagonal move reads
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        diagonal = np.where(inside, cost + ~same, big)
        up = np.append(cost[1:], big) + 1  # leaves an item character out, from one diagonal to the right
        from_up = up < diagonal
        now = np.where(from_up, up, diagonal)
        begin = np.where(from_up, np.append(start[1:], 0), start)
        packed = np.minimum.accumulate(((now - steps + width) << 21) + steps)
        best, origin = packed >> 21, packed & ((1 << 21) - 1)
        cost, start = best + steps - width, begin[origin]
        if cost.min() > k:
            return k + 1, 0, 0
    ends = diagonals + len(item)
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, big)
    j = int(cost.argmin())
    return (int(cost[j]), int(start[j]), int(ends[j])) if cost[j] <= k else (k + 1, 0, 0)


def steps(n: np.ndarray) -> list[slice]:
    """Slices of places that share about STEP entries each, one place at least; n is the number of entries of each."""
    ends = np.cumsum(n)
    out, at = [], 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        out.append(slice(at, stop))
        at = stop
    return out


def candidate_bands(points: np.ndarray, index: Index) -> dict[tuple[int, int], int]:
    """(item, band) of diagonals that may hold an occurrence, with an upper bound of the q-grams they share.

    A q-gram of an item counts once in a band, or once in each step where the entries take several, which only lets more
    bands through to the alignment.
    """
    found = grams(points, index.q)
    at = np.flatnonzero(index.filter[slots(found)])
    k = np.minimum(np.searchsorted(index.known, found[at]), len(index.known) - 1)
    same = index.known[k] == found[at]
    at, k = at[same], k[same]
    first, n = index.first[k], index.first[k + 1] - index.first[k]
    parts = steps(n)

    def entries(part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, its offset and its band (a band spans two strides: its own and the one after) of each shared q-gram."""
        f, m = first[part], n[part]
        entry = np.repeat(f - np.cumsum(m) + m, m) + np.arange(m.sum())
        item, offset = index.item[entry], index.offset[entry]
        return item, offset, (np.repeat(at[part], m) - offset) // (index.edits[item] + 1)

    # upper bounds of the counts, in a table of hashed bands: most bands end here
    size = 1 << min(22, (4 * int(n.sum())).bit_length())
    counts = np.zeros(size, np.int64)
    cell = lambda item, band: (item * 1_000_003 + band) & (size - 1)
    held = [entries(p) for p in parts] if len(parts) == 1 else None
    for p in range(len(parts)):
        item, _, band = held[p] if held else entries(parts[p])
        counts += np.bincount(cell(item, band), minlength=size)
    total: dict[tuple[int, int], int] = {}
    for p in range(len(parts)):
        item, offset, band = held[p] if held else entries(parts[p])
        c = cell(item, band)
        near = counts[c] + np.maximum(counts[(c + 1) & (size - 1)], counts[(c - 1) & (size - 1)]) >= index.bound[item]
        if not near.any():
            continue
        item, offset, band = item[near], offset[near], band[near]
        hits = np.concatenate([np.stack([item, band, offset]), np.stack([item, band - 1, offset])], axis=1)
        shift = band.min() - 1
        key = (hits[0] << 40) | (hits[1] - shift)  # fewer than 2**40 bands in a text
        order = np.lexsort((hits[2], key))
        key, off = key[order], hits[2][order]
        new = np.append(True, (key[1:] != key[:-1]) | (off[1:] != off[:-1]))
        keys, number = np.unique(key[new], return_counts=True)
        for x, m in zip(keys.tolist(), number.tolist(), strict=True):
            b = (x >> 40, (x & ((1 << 40) - 1)) + shift)
            total[b] = total.get(b, 0) + m
    return {b: m for b, m in total.items() if m >= index.bound[b[0]]}


def search_index(data: str, points: np.ndarray, index: Index | Words) -> dict[tuple[int, int, int], int]:
    """{(item number, start, end): edits} of occurrences in a normalised text and its code points."""
    results: dict[tuple[int, int, int], int] = {}
    if isinstance(index, Words):
        framed = f" {data} "
        for i, item in enumerate(index.items):
            at = framed.find(f" {item} ")
            while at >= 0:
                results[i, at, at + len(item)] = 0
                at = framed.find(f" {item} ", at + 1)
        return results
    for i, band in sorted(candidate_bands(points, index)):
        k = int(index.edits[i])
        low = int(band) * (k + 1)
        exact = data.find(index.items[i], max(0, low), low + 2 * k + 2 + len(index.items[i]))
        e, s, t = (0, exact, exact + len(index.items[i])) if exact >= 0 else banded_distance(index.points[i], points, low - k, low + 3 * k + 2, k)
        if e <= k:
            results[i, s, t] = min(e, results.get((i, s, t), e))
    return results


def search(text: str | None, indexes: list[Index | Words]) -> list[tuple[object, int, int, int]]:
    """(item id, start, end, edits) of occurrences in a text, in its code points, by start."""
    if not text or not indexes:
        return []
    data, out = normalise(text), []
    points = codes(data)
    for index in indexes:
        if results := search_index(data, points, index):
            out += [(index.ids[i], s, t, e) for i, s, t, e in best_apart(results)]
    return _in_code_points(text, sorted(out, key=lambda x: (x[1], x[2], str(x[0])))) if out else []


def best_apart(results: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int, int]]:
    """Of overlapping occurrences of one item the one with the fewest edits, the first of equals."""
    out: list[tuple[int, int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for (i, s, t), e in sorted(results.items(), key=lambda x: (x[0][0], x[1], x[0][1:])):
        mine = taken.setdefault(i, [])  # disjoint spans by start: only the neighbours can overlap
        at = bisect.bisect_left(mine, (s, t))
        if (at == 0 or mine[at - 1][1] <= s) and (at == len(mine) or mine[at][0] >= t):
            mine.insert(at, (s, t))
            out.append((i, s, t, e))
    return out


def _origins(text: str, low: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each code point of ``low``, the composed lower case of ``text``, begins and ends in the text."""
    if len(low) == len(text) and low == text.lower():
        return np.arange(len(low)), np.arange(len(low)) + 1
    begins, ends, at = [], [], 0
    while at < len(text):
        stop = at + 1
        # what may be composed with the letter before it: marks, and the parts of a Hangul syllable
        while stop < len(text) and (unicodedata.category(text[stop])[0] == "M" or "\u1100" <= text[stop] <= "\u11ff"):
            stop += 1
        n = len(composed(text[at:stop]))
        begins += [at] * n if n != stop - at else range(at, stop)
        ends += [stop] * n if n != stop - at else range(at + 1, stop + 1)
        at = stop
    # lower case can depend on what stands around; then the places are the nearest
    fit = lambda x: np.array(x + [len(text)] * max(0, len(low) - len(x)))[: len(low)]
    return fit(begins), fit(ends)


def _in_code_points(text: str, spans: list[tuple]) -> list[tuple]:
    """Spans of a normalised text as spans of the text, from the first letter to the last."""
    low = composed(text)
    begins, ends = _origins(text, low)
    letters = np.flatnonzero(letter_table()[codes(low)])
    # between two words stands one space
    places = np.arange(len(letters)) + np.append(0, np.cumsum(np.diff(letters) > 1)) if len(letters) else letters
    out = []
    for i, s, t, e in spans:
        first = min(int(np.searchsorted(places, s)), len(letters) - 1)
        last = max(first, int(np.searchsorted(places, t)) - 1)
        out.append((i, int(begins[letters[first]]), int(ends[letters[last]]), e))
    return out


def _named(item) -> str:
    """An item's id as it stands in spans: what separates their parts is written in hexadecimal."""
    return str(item).replace("%", "%25").replace(":", "%3A").replace(",", "%2C")


def blocks(benchmark: DataFrame, rate: float = ERROR_RATE):
    """Indexes over ``benchmark(item_id, text)``, each of about BLOCK_CHARS characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // BLOCK_CHARS + 1
    for b in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield build([(r.item_id, r.text) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()], rate)


def flagged(docs: DataFrame, indexes: list[Index | Words], keep: list[str], name: str = "_spans") -> DataFrame:
    """``keep`` columns of ``docs`` and what ``search`` finds: strings item:start:end:edits, comma-joined."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            rows = [search(t, indexes) for t in part.column("text").to_pylist()]
            return {name: [",".join(f"{_named(i)}:{s}:{t}:{e}" for i, s, t, e in r) for r in rows]}

        return step

    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), f"`{name}` string", make, keep=keep)


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, contaminated, n_items, n_spans, spans of every document; spans are item:start:end:edits in code points.

    Edits are of letters, marks and digits in composed form, in any script. In an item's id %, : and , are written %25, %3A, %2C.

    Null or empty text: clean. Null items and items without letters or digits are never found. Equal items are found each.
    Repeated rows are searched each, whatever the number of passes. Very long texts are searched whole, in steps of bounded
    memory. No benchmark: all clean. No rows: no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("_tag", F.unhex(F.md5("text")))
    each_pass = blocks(benchmark, rate)
    first = next(each_pass)
    if (second := next(each_pass, None)) is None:
        rows = flagged(rows, first, ["doc_id"])
    else:  # one index at a time; what is found in a text follows from the text
        parts = [materialize(flagged(rows, index, ["_tag"]).filter("_spans <> ''").distinct(), "hits") for index in itertools.chain((first, second), each_pass)]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        by_start = lambda a, b: F.split_part(a, F.lit(":"), F.lit(2)).cast("int") - F.split_part(b, F.lit(":"), F.lit(2)).cast("int")
        spans = F.array_sort(F.array_sort(F.flatten(F.collect_list(F.split("_spans", ",")))), by_start)
        hits = hits.groupBy(F.col("_tag").alias("_its")).agg(F.array_join(spans, ",").alias("_spans"))
        rows = rows.select("doc_id", "_tag").join(hits, F.col("_tag") == F.col("_its"), "left").select("doc_id", F.coalesce("_spans", F.lit("")).alias("_spans"))
    each = F.filter(F.split("_spans", ","), lambda x: x != "")
    items = F.array_distinct(F.transform(each, lambda x: F.substring_index(x, ":", 1)))
    return rows.select("doc_id", (F.col("_spans") != "").alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.size(each).cast("long").alias("n_spans"), F.col("_spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found; nulls, repeated and no rows as in ``scan``."""
    rows = packed(docs, "text")
    for n, index in enumerate(blocks(benchmark, rate)):
        if n:
            rows = materialize(rows, "clean")
        rows = flagged(rows, index, ["text", "_row"], "_spans").filter("_spans = ''").drop("_spans")
    return rows.select(*unpacked(rows, docs.columns, "text"))
