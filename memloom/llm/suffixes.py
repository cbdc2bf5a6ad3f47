"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Only suffixes
that can share LENGTH bytes are sorted: each window of LENGTH bytes belongs to its least-hashed K-gram (its anchor; equal
windows have equal anchors at equal places), and anchors that only one document has are dropped first. The others are
dealt into parts by their hash, so that a part holds all windows that can be equal, as the contexts of their anchors.

The contexts of a part, one after the other, are its text. Ranks of the suffixes at the places of a difference cover
are computed first, by doubling. Then the suffixes are sorted one bucket of beginnings at a time: by their first PERIOD
bytes, and where these tie, two suffixes are compared by the ranks at a shift that leads both of them onto the cover; there
is one below PERIOD for any two places. Neighbours in that order that share LENGTH bytes are equal strings. One part,
and of it the suffixes of one bucket, is in memory at a time.

Arrays travel as binary columns: a row holds those of one task for one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH = 50
K = 20
#: Most bytes between a window's start and its anchor.
REACH = LENGTH - K
CONTEXT = REACH + LENGTH
#: Difference cover modulo PERIOD: every residue is a difference of two elements.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: Suffixes of a bucket, about: beginnings of two bytes are put together up to it.
BUCKET = 1 << 18
#: Text of one group of documents, and text whose anchors make one part, about.
GROUP_BYTES, PART_BYTES = 3 << 20, 1 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id: no id is larger

FACTOR = 0x9E3779B97F4A7C15
POWERS = {e: np.uint64(pow(FACTOR, e, 1 << 64)) for e in (1, 2, 4, 8, 16)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """48-bit hashes of all K-grams, in the high bits: powers of two are joined to K bytes."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * POWERS[1] + h1[1:]
    h4 = h2[:-2] * POWERS[2] + h2[2:]
    h8 = h4[:-4] * POWERS[4] + h4[4:]
    h16 = h8[:-8] * POWERS[8] + h8[8:]
    h = h16[:-4] * POWERS[4] + h4[16:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    return h & np.uint64(0xFFFFFFFFFFFF0000)


def sliding_least(x: np.ndarray) -> np.ndarray:
    """Minimum of every run of REACH + 1 = 31 values."""
    for step in (1, 2, 4, 8):
        x = np.minimum(x[:-step], x[step:])
    return np.minimum(x[:-15], x[15:])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document: hash, position, first and last window that they stand for."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = gram_hashes(data)
    place = np.empty(n, np.int64)
    for at in range(0, n, 60_000):  # a place in the low 16 bits makes the first of equal hashes the least
        part = hashes[at : at + 60_000 + REACH]
        least = sliding_least(part | np.arange(len(part), dtype=np.uint64))
        place[at : at + len(least)] = at + (least & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    return hashes[place[first]] >> np.uint64(16), place[first], first, last


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def packed(hashes: np.ndarray) -> tuple[bytes, bytes]:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (hashes >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)


def joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x] + [np.zeros(0, kind)])


def cuts(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Value and slice of each run of sorted ``keys``."""
    if not len(keys):
        return
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for a, b in zip(at, np.append(at[1:], len(keys)), strict=True):
        yield int(keys[a]), slice(int(a), int(b))


HASHES = "part int, group int, docs binary, counts binary, low binary, high binary"
SHARED = "group int, docs binary, counts binary, low binary, high binary"
CONTEXTS = "part int, group int, docs binary, turns binary, low binary, high binary, windows binary, nears binary, fars binary, bytes binary, sdocs binary, sturns binary, starts binary, ends binary"
SPANS = "group int, docs binary, turns binary, starts binary, ends binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_arrow(schema))


def copied_texts(right: pa.Table) -> set[bytes]:
    """Ids and digests of the texts that are exact copies of another document's."""
    listed = b"".join(x for x in right.column("copy").to_pylist() if x)
    return {listed[at : at + 24] for at in range(0, len(listed), 24)}


def text_key(doc: int, text: bytes) -> bytes:
    """Id and digest of one text: a document may have other texts that are no copies."""
    return doc.to_bytes(8, "big", signed=True) + hashlib.md5(text).digest()


def anchor_hashes(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """Anchor hashes of the documents of a group, by part of the hash range; exact copies of another document have none.

    Of the documents that have the same hash only the least and the greatest id go on: they tell whether several documents have it,
    so a hash that very many documents share comes twice from each group, and not once from each document.
    """
    copies = copied_texts(right)
    ids, hashes, seen = [], [], set()
    for doc, turn, text in group_texts(left):
        if (doc, turn) in seen or text_key(doc, text) in copies:
            continue
        seen.add((doc, turn))
        h = np.unique(anchors(np.frombuffer(text, np.uint8))[0])
        if len(h):
            ids.append(doc)
            hashes.append(h)
    if not ids:
        return _table([], HASHES)
    h = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in hashes])
    order = np.lexsort((np.array(ids, np.int64)[owner], h))
    change = np.flatnonzero(h[order][1:] != h[order][:-1])
    ends = np.unique(order[np.concatenate([[0], change + 1, change, [len(h) - 1]])])
    h, owner = h[ends], owner[ends]
    part = part_of(h, parts)
    order = np.argsort(part, kind="stable")
    h, owner, part, doc = h[order], owner[order], part[order], np.array(ids, np.int64)
    group = left.column("group")[0].as_py()
    rows = []
    for p, cut in cuts(part):
        o = owner[cut]
        first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        low, high = packed(h[cut])
        rows.append({"part": p, "group": group, "docs": doc[o[first]].tobytes(), "counts": np.diff(np.append(first, len(o))).astype(np.int32).tobytes(), "low": low, "high": high})
    return _table(rows, HASHES)


def shared_hashes(table: pa.Table) -> pa.Table:
    """Of one part, the hashes that two or more documents have, by group of documents and those of its documents that told of them."""
    counts = joined(table, "counts", np.int32)
    doc = np.repeat(joined(table, "docs", np.int64), counts)
    sizes = [len(x) // 6 for x in (a + b for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist(), strict=True))]
    group = np.repeat(np.array(table.column("group").to_pylist(), np.int32), sizes)
    h = np.concatenate([unpacked(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist(), strict=True)])
    order = np.argsort(h, kind="stable")
    h, doc, group = h[order], doc[order], group[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    keep = np.repeat(two, np.diff(np.append(first, len(h))))
    h, doc, group = h[keep], doc[keep], group[keep]
    order = np.lexsort((doc, group))
    h, doc, group = h[order], doc[order], group[order]
    rows = []
    for g, cut in cuts(group):
        d = doc[cut]
        at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        low, high = packed(h[cut])
        rows.append({"group": g, "docs": d[at].tobytes(), "counts": np.diff(np.append(at, len(d))).astype(np.int32).tobytes(), "low": low, "high": high})
    return _table(rows, SHARED)


def group_texts(left: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, turn, bytes) of a group's rows; turn tells different texts of one doc_id apart, in order of their bytes."""
    ids = left.column("doc_id").to_pylist()
    texts = [t.encode("utf-8", "surrogatepass") for t in left.column("text").to_pylist()]
    several: dict[int, set[bytes]] = {}
    if len(set(ids)) < len(ids):
        for i, t in zip(ids, texts, strict=True):
            several.setdefault(i, set()).add(t)
    for i, t in zip(ids, texts, strict=True):
        yield i, sorted(several[i]).index(t) if len(several.get(i, ())) > 1 else 0, t


def contexts(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """Bytes around the shared anchors of a group of documents, by part; exact copies of another document are left out.

    Of equal contexts in the group only those of the least document go on: it shows the others' windows to be repeated, whose
    spans are passed along. So a passage that very many documents share is in the parts once for each group.
    """
    copies = copied_texts(right)
    shared = np.unique(np.concatenate([unpacked(a or b"", b or b"") for a, b in zip(right.column("low").to_pylist(), right.column("high").to_pylist(), strict=True)] + [np.zeros(0, np.uint64)]))
    if not len(shared):
        return _table([], CONTEXTS)
    got: list[list[np.ndarray]] = [[] for _ in range(7)]
    seen = set()
    offsets = np.arange(CONTEXT)
    for doc, turn, text in group_texts(left):
        if (doc, turn) in seen or text_key(doc, text) in copies:
            continue
        seen.add((doc, turn))
        data = np.frombuffer(text, np.uint8)
        hashes, place, first, last = anchors(data)
        keep = shared[np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)] == hashes
        if not keep.any():
            continue
        hashes, place, first, last = hashes[keep], place[keep], first[keep], last[keep]
        at = place[:, None] - REACH + offsets
        inside = (at >= first[:, None]) & (at < last[:, None] + LENGTH)  # only bytes of the anchor's own windows
        some = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
        for out, x in zip(got, (hashes, np.full(len(place), doc, np.int64), np.full(len(place), turn, np.uint16), first.astype(np.int32), (place - last).astype(np.uint8), (place - first).astype(np.uint8), some), strict=True):
            out.append(x)
    if not got[0]:
        return _table([], CONTEXTS)
    hashes, doc, turn, first, near, far, some = (np.concatenate(x) for x in got)
    group = left.column("group")[0].as_py()
    keys = (hashes, near, far, *[words_of(some, o, o + 8) for o in range(0, CONTEXT, 8)])
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.flatnonzero(new)
    least = np.repeat(doc[order][head], np.diff(np.append(head, len(order))))
    gone = order[doc[order] > least]
    rows = []
    if len(gone):
        gone = gone[np.lexsort((first[gone], doc[gone]))]
        ends = first[gone] + far[gone].astype(np.int32) - near[gone] + LENGTH
        rows.append({"part": group % parts, "group": group, "docs": b"", "turns": b"", "low": b"", "high": b"", "windows": b"", "nears": b"", "fars": b"", "bytes": b"", "sdocs": doc[gone].tobytes(), "sturns": turn[gone].tobytes(), "starts": first[gone].tobytes(), "ends": ends.astype(np.int32).tobytes()})
        left_over = np.ones(len(doc), bool)
        left_over[gone] = False
        hashes, doc, turn, first, near, far, some = (x[left_over] for x in (hashes, doc, turn, first, near, far, some))
    part = part_of(hashes, parts)
    order = np.argsort(part, kind="stable")
    for p, cut in cuts(part[order]):
        o = order[cut]
        low, high = packed(hashes[o])
        rows.append({"part": p, "group": group, "docs": doc[o].tobytes(), "turns": turn[o].tobytes(), "low": low, "high": high, "windows": first[o].tobytes(), "nears": near[o].tobytes(), "fars": far[o].tobytes(), "bytes": some[o].tobytes()})
    return _table(rows, CONTEXTS)


def words_of(block: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Bytes start..stop (at most 8) of each row as one big-endian number, whose order is that of the bytes."""
    out = np.zeros((len(block), 8), np.uint8)
    out[:, : stop - start] = block[:, start:stop]
    return out.view(">u8").astype(np.uint64).ravel()


def dense_ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of rows by ``keys``, the first key the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def places(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Residues of the places of bytes in a part's text, in which a separator follows each context."""
    return ((CONTEXT + 1) * rows.astype(np.int64) + offsets) % PERIOD


def beginnings(block: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of suffixes as two numbers, whose order is that of the bytes; zeros follow a context."""
    padded = np.zeros((len(block), CONTEXT + 16), np.uint8)
    padded[:, :CONTEXT] = block
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 16, axis=1)[rows, offsets]).view(">u8").astype(np.uint64)
    return words[:, 0], words[:, 1]


def cover_ranks(block: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes (to the end of their context) at the places of the difference cover, by row and offset.

    The first rank is by 16 bytes; each round doubles what it covers, as a place PERIOD further is on the cover too. Columns
    from CONTEXT on hold the rank of nothing; those of other places are not used.
    """
    offsets = np.arange(CONTEXT)
    # the pattern of places on the cover repeats every PERIOD rows
    on = np.isin(places(np.arange(PERIOD)[:, None], offsets), COVER)
    rows, at = np.nonzero(np.tile(on, (len(block) // PERIOD + 1, 1))[: len(block)])
    nothing = np.uint64(0)
    keys = beginnings(block, rows, at)
    rows, at = rows.astype(np.int32), at.astype(np.int8)
    table = np.zeros((len(block), CONTEXT + PERIOD), np.int32)
    for step in (PERIOD, 2 * PERIOD, 4 * PERIOD, 8 * PERIOD):  # 16, 32, 64, 128 bytes
        _, ranks = dense_ranks(*(np.append(k, nothing) for k in keys))
        table[:] = ranks[-1]
        table[rows, at] = ranks[:-1]
        nothing = ranks[-1].astype(np.int32)
        keys = (ranks[:-1].astype(np.int32), table[rows, np.minimum(at.astype(np.int16) + step, CONTEXT)])
        del ranks
    return table


#: The least shift that leads places of two residues onto the cover.
SHIFTS = np.array([[next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def suffix_order(block: np.ndarray, table: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffixes of one bucket in order: by 16 bytes, ties by cover ranks.

    Suffixes that tie are dealt by the residue of their place. Two of one residue compare at one shift, so each residue
    is sorted by itself; a suffix's position among all is the sum of its positions among those of each residue.
    """
    _, group = dense_ranks(*beginnings(block, rows, offsets))
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    position = np.zeros(len(rows), np.int64)
    residue = places(rows[tied], offsets[tied])
    most = int(table.max()) + 1
    of = {r: tied[residue == r] for r in range(PERIOD)}

    def keys(r: int, shift: int) -> np.ndarray:
        return group[of[r]] * np.int64(most) + table[rows[of[r]], offsets[of[r]] + shift]

    for a in range(PERIOD):
        if not len(of[a]):
            continue
        own = keys(a, SHIFTS[a, a])
        position[of[a][np.argsort(own, kind="stable")]] = np.arange(len(own))
        for b in range(PERIOD):
            if a != b and len(of[b]):
                shift = SHIFTS[a, b]
                position[of[a]] += np.searchsorted(np.sort(keys(b, shift)), keys(a, shift), "right" if b < a else "left")
    return np.lexsort((position, group))


def least_ids(block: np.ndarray, doc: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each row and distance from the anchor (near..far) the least doc with the same LENGTH bytes."""
    out = np.full((len(block), REACH + 1), LAST, np.int64)
    if not len(block):
        return out
    table = cover_ranks(block)
    size = far - near + 1
    rows = np.repeat(np.arange(len(block), dtype=np.int32), size)
    distance = (np.arange(size.sum(), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size) + near.astype(np.int32)[rows]).astype(np.int8)
    offsets = np.int8(REACH) - distance
    start = block[rows, offsets].astype(np.uint16) << np.uint16(8) | block[rows, offsets + 1]
    order = np.argsort(start, kind="stable").astype(np.int32)
    windows = np.lib.stride_tricks.sliding_window_view(block, LENGTH, axis=1)
    start = start[order]
    ends = np.flatnonzero(np.append(start[1:] != start[:-1], True)) + 1  # of the suffixes of each beginning
    del start
    at = 0
    while at < len(order):
        stop = int(ends[max(np.searchsorted(ends, at + BUCKET, "right") - 1, np.searchsorted(ends, at, "right"))])
        some = order[at:stop]
        some = some[suffix_order(block, table, rows[some], offsets[some])]
        bytes_of = windows[rows[some], offsets[some]]
        first = np.flatnonzero(np.append(True, (bytes_of[1:] != bytes_of[:-1]).any(1)))
        least = np.minimum.reduceat(doc[rows[some]], first)
        out[rows[some], distance[some]] = np.repeat(least, np.diff(np.append(first, len(some))))
        at = stop
    return out


def removed_spans(table: pa.Table) -> pa.Table:
    """Spans of bytes to remove that one part of the buckets shows, by group of documents."""
    doc, turn = joined(table, "docs", np.int64), joined(table, "turns", np.uint16)
    sizes = [len(x) // 8 for x in table.column("docs").to_pylist()]
    group = np.repeat(np.array(table.column("group").to_pylist(), np.int32), sizes)
    bucket = np.concatenate([unpacked(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist(), strict=True)])
    first, near, far = joined(table, "windows", np.int32).astype(np.int64), joined(table, "nears", np.uint8).astype(np.int64), joined(table, "fars", np.uint8).astype(np.int64)
    block = joined(table, "bytes", np.uint8).reshape(-1, CONTEXT)
    known = [{"group": g, "docs": d, "turns": t, "starts": a, "ends": b} for g, d, t, a, b in zip(*(table.column(c).to_pylist() for c in ("group", "sdocs", "sturns", "starts", "ends")), strict=True) if d]
    del table
    if not len(doc):
        return _table(known, SPANS)
    # equal contexts are one row from here on, under the least id
    words = [words_of(block, o, o + 8) for o in range(0, CONTEXT, 8)]
    mixed = bucket * np.uint64(FACTOR)
    for w in words:
        mixed = (mixed ^ w) * np.uint64(0x7FB5D329728EA185)
        mixed ^= mixed >> np.uint64(29)
    order = np.lexsort((mixed, bucket))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in (bucket, near, far, *words):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], heads)
    head = order[heads]
    head_bucket = bucket[head]
    # a bucket with one kind of context needs no sorting
    start = np.append(True, head_bucket[1:] != head_bucket[:-1])
    in_bucket = np.bincount(np.cumsum(start) - 1)
    several = np.flatnonzero(np.repeat(in_bucket > 1, in_bucket))
    table_of = np.full(len(heads), -1, np.int64)
    table_of[several] = np.arange(len(several))
    ids = least_ids(block[head[several]], least[several], near[head[several]], far[head[several]])
    alone = table_of[kind] < 0
    rows = np.flatnonzero(alone & (least[kind] < doc))
    spans = [(rows, first[rows], first[rows] + far[rows] - near[rows] + LENGTH)]
    rows = np.flatnonzero(~alone)
    distance = np.arange(REACH + 1)
    gone = (ids[table_of[kind[rows]]] < doc[rows, None]) & (near[rows, None] <= distance) & (distance <= far[rows, None])
    edge = np.zeros((len(rows), 1), np.int8)
    change = np.diff(np.concatenate([edge, gone.astype(np.int8), edge], axis=1), axis=1)
    r, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    place = first[rows[r]] + far[rows[r]]  # of the anchor
    spans.append((rows[r], place - (end - 1), place - begin + LENGTH))
    rows, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.lexsort((a, doc[rows], group[rows]))
    rows, a, b = rows[order], a[order], b[order]
    return _table(known + [{"group": g, "docs": doc[rows[cut]].tobytes(), "turns": turn[rows[cut]].tobytes(), "starts": a[cut].astype(np.int32).tobytes(), "ends": b[cut].astype(np.int32).tobytes()} for g, cut in cuts(group[rows])], SPANS)


def cleaned(left: pa.Table, right: pa.Table) -> pa.Table:
    """The result rows of a group of documents."""
    copies = copied_texts(right)
    doc, turn = joined(right, "docs", np.int64), joined(right, "turns", np.uint16)
    start, end = joined(right, "starts", np.int32), joined(right, "ends", np.int32)
    order = np.lexsort((start, turn, doc))
    doc, turn, start, end = doc[order], turn[order], start[order].astype(np.int64), end[order].astype(np.int64)
    mine = {d: cut for d, cut in cuts(doc)}
    rows = []
    for d, t, text in group_texts(left):
        n, spans = len(text), []
        if n >= LENGTH and text_key(d, text) in copies:
            spans = [(0, n)]
        elif d in mine:
            cut = mine[d]
            own = turn[cut] == t
            a, b = start[cut][own], np.maximum.accumulate(end[cut][own]) if own.any() else end[:0]
            at = np.flatnonzero(np.append(True, a[1:] > b[:-1])) if len(a) else a
            spans = list(zip(a[at].tolist(), np.append(b[at[1:] - 1], b[-1:]).tolist(), strict=True)) if len(a) else []
        kept, last = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(text[last:a])
            last = b
        kept.update(text[last:])
        rows.append({"doc_id": None if d == LAST else d, "n_bytes": n, "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest()})
    return _table(rows, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document of ``docs(doc_id, text)``.

    Null text: no bytes. Null doc_id: larger than any other id. Rows with one doc_id do not count against each other, and each of
    its texts is judged by itself. Texts of fewer than LENGTH bytes stay. Exact copies of a text go whole, without
    expansion. A very long text is handled whole, in one task. No rows: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 31, max(2 * tasks, total // PART_BYTES + 1))
    groups = max(4 * tasks, total // GROUP_BYTES + 1)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST)))
    rows = docs.select(doc.alias("doc_id"), F.pmod(F.xxhash64(doc, F.coalesce("text", F.lit(""))), F.lit(groups)).cast("int").alias("group"), F.coalesce("text", F.lit("")).alias("text"))
    digest = rows.select("doc_id", "group", F.unhex(F.md5("text")).alias("digest"))
    # a table of the digests of several documents: beside it, adaptive execution can split a digest that very many share
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = materialize(least, "copied")
    nothing = F.lit(None).cast("binary")
    copies = digest.join(least, "digest").filter("doc_id > least").select(F.col("group").alias("own"), "doc_id", "digest").distinct().withColumnRenamed("own", "group")
    copies = copies.select("group", nothing.alias("docs"), F.concat(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), "digest").alias("copy"))
    copied = copies.groupBy("group")
    hashed = rows.groupBy("group").cogroup(copied).applyInArrow(lambda left, right: anchor_hashes(left, right, parts) if left.num_rows else _table([], HASHES), HASHES)
    shared = hashed.groupBy("part").applyInArrow(shared_hashes, SHARED)
    hints = shared.withColumn("copy", nothing).unionByName(copies, allowMissingColumns=True)
    found = rows.groupBy("group").cogroup(hints.groupBy("group")).applyInArrow(lambda left, right: contexts(left, right, parts) if left.num_rows else _table([], CONTEXTS), CONTEXTS)
    spans = found.groupBy("part").applyInArrow(removed_spans, SPANS)
    marks = spans.withColumn("copy", nothing).unionByName(copies, allowMissingColumns=True)
    return rows.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(lambda left, right: cleaned(left, right) if left.num_rows else _table([], RESULT), RESULT)
