"""Line dedup by a segment-partition edit join, in DataFrame functions only.

The first occurrence of a line, by (doc_id, text, position), stays; later occurrences go, and so does a first occurrence
that is within a few edits of a line which occurs earlier. How many depends on the length: ``BUDGETS``. Distinct
lines are cut into edits + 1 segments of even length; a line within the edits of another holds one of its segments
whole, at a place that the position filter bounds. Segments are indexed under (length, number, content), substrings of
lines look them up for each length in reach, and the candidates are verified by a banded bit-parallel edit distance on
long columns.

A bucket with many lines on both sides is not paired. Its lines are cut finer (``finer``): two edits fall into one
or two of four cells, and the rest of the line goes into the key; buckets that stay full are cut again inside those
cells, down to single characters, where all lines of a bucket are near and the earliest place settles the others.
So the pairs follow the lines, however many near copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, packed

SPACES = " \t\r\v\f"
#: (least length, edits): edits that two lines may be apart, by the length of the shorter one; below the first, none.
BUDGETS = ((8, 1), (16, 2))
#: Lines that a bucket has on both sides before it is cut finer.
FULL = 32
#: Cells of a gap that is cut.
CELLS = 4
#: One line in so many is looked at to find keys that very many lines have, and lines of those that make a key common.
SAMPLE, COMMON = 64, 16
#: Candidate lines up to which the list of them is broadcast (24 bytes a line); beyond, the texts are shuffled.
BROADCAST_LINES = 200_000
#: Characters whose counts make a line's signature, a long for each eight, eight bits for each.
LETTERS = ("eaontirh", "sdlcuwy ")


def text_tag(text: Column) -> Column:
    """Tells different texts of one doc_id apart; rows that are equal in both share their lines."""
    return F.xxhash64(text)


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tag, pos, line for every line with a word, outer white space trimmed."""
    each = docs.select("doc_id", text_tag(F.col("text")).alias("tag"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return each.select("doc_id", "tag", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).filter("line <> ''")


def same_line(line: Column) -> dict[str, Column]:
    """Two 64-bit hashes by which lines are the same."""
    return {"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(1), line)}


def place() -> Column:
    """Order of lines: null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "tag", "pos")


def signature(line: Column, length: Column) -> Column:
    """Counts of LETTERS modulo 256, packed into longs."""

    def word(letters: str) -> Column:
        counts = [(length - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(255)) for c in letters]
        return sum((F.shiftleft(c, 8 * i) for i, c in enumerate(counts[1:], 1)), counts[0])

    return F.struct(*[word(letters).alias(f"w{k}") for k, letters in enumerate(LETTERS)])


def count_distance(a: Column, b: Column) -> Column:
    """A lower bound of how much the letter counts of two lines differ; an edit changes it by two at most."""
    count = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))
    each = [(count(a[f"w{k}"], i) - count(b[f"w{k}"], i)).bitwiseAND(F.lit(255)) for k, letters in enumerate(LETTERS) for i in range(len(letters))]
    return sum((F.least(d, F.lit(256) - d) for d in each[1:]), F.least(each[0], F.lit(256) - each[0]))


def segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``number`` (from 0) of a line: short segments first, the rest one longer."""
    parts = edits + 1
    longer = length % parts
    short = ((length - longer) / parts).cast("int")
    before = F.greatest(F.lit(number) - (parts - longer), F.lit(0))
    return F.lit(number) * short + before + 1, short + (F.lit(number) >= parts - longer).cast("int")


def segment_keys(line: Column, length: Column, edits: int) -> tuple[list[Column], list[tuple[int, Column]]]:
    """Keys under which a line is indexed, and (how much shorter, key) that it looks up among lines at most ``edits`` shorter.

    The first are looked up too, among lines of equal length.
    """
    key = lambda number, size, text: F.xxhash64(F.lit(edits), F.lit(number), size, text)
    index, probes = [], []
    for i in range(edits + 1):
        start, size = segment(length, i, edits)
        index.append(key(i, length, F.substring(line, start, size)))
    for shorter in range(edits + 1):
        other = (length - shorter).cast("int")
        for i in range(edits + 1):
            start, size = segment(other, i, edits)
            # edits before the segment shift it by at most i, edits after it by at most edits - i, from the end
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or shift:
                    probes.append((shorter, key(i, other, F.substring(line, start + shift, size))))
    return index, probes


def line_keys(line: Column, length: Column, edits: int) -> tuple[list[Column], list[int]]:
    """A line's keys under one budget, and what each is: -1 for an index key, which is looked up as well, else how much shorter the
    lines are that it looks up."""
    index, probes = segment_keys(line, length, edits)
    return index + [k for _, k in probes], [-1] * len(index) + [shorter for shorter, _ in probes]


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two lines if it is at most ``edits``, else a larger number; a is not longer than b.

    Bit r of a column of the table stands for row j - edits + r of column j. The vertical differences of the band
    are two bit sets that move down a row with each character of b. The score follows the band's lowest row, then
    the last row of the table.
    """
    width = 2 * edits + 2
    full = (1 << width) - 1
    top = width - 1
    bits = lambda v: v.bitwiseAND(F.lit(full))
    bit = lambda v, at: F.when(bits(v).bitwiseAND(at) != 0, F.lit(1)).otherwise(F.lit(0))
    power = F.array(*[F.lit(1 << r).cast("long") for r in range(width)])

    def let(value: Column, use) -> Column:
        """``use`` of a value that is computed once: a lambda's variable holds it."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def distance(pair: Column) -> Column:
        x, y, m = pair["x"], pair["y"], pair["m"]

        def step(state: Column, j: Column) -> Column:
            def matches(c: Column) -> Column:
                out = F.lit(0).cast("long")
                for r in range(width - 1):
                    i = j + (edits - r)
                    out = out + F.when((i >= 1) & (i <= m) & (F.get(x, i - 1) == c), F.lit(1 << (top - r)).cast("long")).otherwise(F.lit(0).cast("long"))
                return out

            def diagonal(pm: Column) -> Column:
                vp = state["vp"]
                d0 = bits(pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(state["vn"])
                return let(d0, horizontal)

            def horizontal(d0: Column) -> Column:
                hp = state["vn"].bitwiseOR(bits(F.bitwise_not(d0.bitwiseOR(state["vp"]))))
                return let(F.struct(d0.alias("d0"), hp.alias("hp"), d0.bitwiseAND(state["vp"]).alias("hn")), after)

            def after(h: Column) -> Column:
                down = F.shiftright(h["d0"], 1)
                low = j + edits  # the band's lowest row, inside the table while it is at most m
                row = F.get(power, top - (low - m))
                score = F.when(low <= m, 1 - bit(h["d0"], F.lit(1 << top))).otherwise(bit(h["hp"], row) - bit(h["hn"], row))
                vp = h["hn"].bitwiseOR(bits(F.bitwise_not(down.bitwiseOR(h["hp"]))))
                return F.struct(vp.alias("vp"), down.bitwiseAND(h["hp"]).alias("vn"), (state["score"] + score).alias("score"))

            return let(F.get(y, j - 1), lambda c: let(matches(c), diagonal))

        start = sum(1 << (top - r) for r in range(edits + 1))
        zero = F.struct(F.lit(start).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).cast("int").alias("score"))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), zero, step)["score"]

    def middle(s: Column) -> Column:
        """The pair without its common beginning and end, which do not change the distance."""
        most = F.length(s["a"])
        # the longest common beginning, one power of two at a time
        halves = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda r: F.pow(F.lit(2.0), r).cast("int"))
        ahead = lambda n, h: F.when((h <= most - n) & (F.substring(s["a"], n + 1, h) == F.substring(s["b"], n + 1, h)), n + h).otherwise(n)
        return let(F.aggregate(halves, F.lit(0), ahead), lambda n: let(F.struct(F.substring(s["a"], n + 1, F.length(s["a"])).alias("a"), F.substring(s["b"], n + 1, F.length(s["b"])).alias("b")), tail))

    def tail(s: Column) -> Column:
        most = F.length(s["a"])
        halves = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda r: F.pow(F.lit(2.0), r).cast("int"))
        back = lambda n, h: F.when((h <= most - n) & (F.substring(s["a"], most - n - h + 1, h) == F.substring(s["b"], F.length(s["b"]) - n - h + 1, h)), n + h).otherwise(n)
        return let(F.aggregate(halves, F.lit(0), back), lambda n: let(F.struct(F.substring(s["a"], 1, most - n).alias("a"), F.substring(s["b"], 1, F.length(s["b"]) - n).alias("b")), rest))

    def rest(s: Column) -> Column:
        pair = F.struct(F.split(s["a"], "").alias("x"), F.split(s["b"], "").alias("y"), F.length(s["a"]).alias("m"))
        # with nothing left of the shorter line, all of the other is inserted
        return F.when(F.length(s["a"]) <= edits, F.levenshtein(s["a"], s["b"])).otherwise(let(pair, distance))

    return F.when(F.length(b) - F.length(a) > edits, F.lit(edits + 1)).otherwise(let(F.struct(a.alias("a"), b.alias("b")), middle))


def cells(size: Column, points: Column) -> Column:
    """Cells of a gap of ``size`` characters (tag, at, size): four parts, or in a short gap each character, or with ``points``
    each place between characters. ``points`` null: both, for index rows, which many probes meet."""
    cell = lambda tag, at, n: F.struct(F.lit(tag).alias("tag"), at.cast("int").alias("at"), n.cast("int").alias("size"))
    edge = lambda j: F.floor(j * size / CELLS)
    wide = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda j: cell(0, edge(j), edge(j + 1) - edge(j)))
    single = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda j: cell(1, j, F.least(F.lit(1), size)))
    between = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(0))), lambda j: cell(2, j, F.lit(0)))
    return F.when(size >= CELLS, wide).when(points.isNull(), F.concat(single, between)).when(points, between).otherwise(single)


def finer(state: DataFrame) -> DataFrame:
    """The rows of full buckets under finer keys.

    ``state(key, id, budget, probe, delta, one, s1, l1, d1, s2, l2, d2, line)``: outside its gaps a line agrees with the others of
    its bucket. With ``one`` the first gap holds at most two edits, else each of both gaps at most one. A gap starts at s (from 0)
    and is l long, d longer than that of the index rows. For each choice of cells that the edits may fall into, what lies
    outside them joins the key.
    """
    text = lambda a, b: F.substring(F.col("line"), a + 1, b - a)
    gap = lambda s, n, d: (s.cast("int"), n.cast("int"), d.cast("int"))
    zero = F.lit(0)

    def row(key: Column, one: bool, first: tuple, second: tuple) -> Column:
        names = ("s1", "l1", "d1", "s2", "l2", "d2")
        return F.struct(key.alias("key"), F.lit(one).alias("one"), *[x.alias(n) for n, x in zip(names, gap(*first) + gap(*second), strict=True)])

    s1, s2 = F.col("s1"), F.col("s2")
    e1, e2 = s1 + F.col("l1"), s2 + F.col("l2")
    d1, d2 = F.col("d1"), F.col("d2")
    # two edits of which both are insertions, or one insertion, fall between characters
    spots = lambda d, most: F.when(F.col("probe"), d == most)

    def split_one(x: Column, y: Column) -> Column:
        """Both edits in cell x (= y), or one in each."""
        key = lambda *rest: F.xxhash64("key", F.lit(1), x["tag"], x["at"], y["at"], text(s1, s1 + x["at"]), *rest)
        together = row(key(F.lit(""), text(s1 + x["at"] + x["size"] + d1, e1)), True, (s1 + x["at"], x["size"] + d1, d1), (zero, zero, zero))

        def apart(d: Column) -> Column:
            middle = text(s1 + x["at"] + x["size"] + d, s1 + y["at"] + d)
            return row(key(middle, text(s1 + y["at"] + y["size"] + d1, e1)), False, (s1 + x["at"], x["size"] + d, d), (s1 + y["at"] + d, y["size"] + d1 - d, d1 - d))

        shifts = F.when(~F.col("probe"), F.array(zero)).when(d1 == 0, F.array(F.lit(-1), zero, F.lit(1))).when(d1 == 1, F.array(zero, F.lit(1))).otherwise(F.array(F.lit(1)))
        return F.when(x["at"] == y["at"], F.array(together)).otherwise(F.transform(shifts, apart))

    def split_two(x: Column, y: Column) -> Column:
        key = F.xxhash64("key", F.lit(2), x["tag"], x["at"], y["tag"], y["at"], text(s1, s1 + x["at"]), text(s1 + x["at"] + x["size"] + d1, e1), text(s2, s2 + y["at"]), text(s2 + y["at"] + y["size"] + d2, e2))
        return row(key, False, (s1 + x["at"], x["size"] + d1, d1), (s2 + y["at"], y["size"] + d2, d2))

    own = cells(F.col("l1") - d1, spots(d1, 2))
    ones = F.flatten(F.flatten(F.transform(own, lambda x: F.transform(F.filter(own, lambda y: (y["tag"] == x["tag"]) & (y["at"] >= x["at"])), lambda y: split_one(x, y)))))
    other = cells(F.col("l2") - d2, spots(d2, 1))
    twos = F.flatten(F.transform(cells(F.col("l1") - d1, spots(d1, 1)), lambda x: F.transform(other, lambda y: split_two(x, y))))
    keep = ("id", "budget", "probe", "delta")
    out = [state.filter(test).select(*keep, F.explode(cut).alias("r")) for test, cut in (("one", ones), ("not one", twos))]
    return out[0].unionByName(out[1]).select(*keep, "r.*")


def all_near() -> Column:
    """Whether every index row of a probe's bucket is near it: its gaps are too small for more edits than they may hold."""
    size1, size2, d1, d2 = F.col("l1") - F.col("d1"), F.col("l2") - F.col("d2"), F.col("d1"), F.col("d2")
    single = lambda size, d: F.when(d == 1, size == 0).otherwise(size <= 1)
    return F.when(F.col("one"), size1 + d1 <= 2).otherwise(single(size1, d1) & single(size2, d2))


def bucket_sizes(rows: DataFrame) -> DataFrame:
    """key and full for the keys under which lines may find others."""
    n_index, n_probe = F.count_if(~F.col("probe")), F.count_if("probe")
    sizes = rows.groupBy("key").agg(n_index.alias("i"), n_probe.alias("p"), F.min("id").alias("a"), F.max("id").alias("b"))
    return sizes.filter("i > 0 and p > 0 and a <> b").select("key", (F.least("i", "p") > FULL).alias("full"))


def split_full(live: DataFrame, text: DataFrame, budgets: tuple[tuple[int, int], ...]) -> tuple[list[DataFrame], list[DataFrame]]:
    """From lines of full buckets, ``live(id, budget, probe, delta)``: candidate rows (key, id, budget, probe, delta) of buckets
    that are no longer full, and places (at) that are settled without a pair."""
    lines = text.select("id", "line", "length")
    index_size = F.col("length") - F.greatest("delta", F.lit(0))
    two = F.element_at(F.array(*[F.lit(e == 2) for _, e in budgets]), F.col("budget") + 1)
    start = live.distinct().join(lines, "id").select("*", F.xxhash64("budget", index_size).alias("key"), two.alias("one"))
    grown = F.greatest("delta", F.lit(0))
    number = lambda c, name: c.cast("int").alias(name)
    state = start.select("key", "id", "budget", "probe", "delta", "one", "line", number(F.lit(0), "s1"), number(F.col("length"), "l1"), number(grown, "d1"), *[number(F.lit(0), n) for n in ("s2", "l2", "d2")])
    cold, settled = [], []
    while True:
        rows = materialize(finer(state), "finer")
        live = materialize(rows.join(bucket_sizes(rows), "key"), "finer-live")
        cold.append(live.filter("not full").select("key", "id", "budget", "probe", "delta"))
        full = live.filter("full")
        ends = full.filter(F.col("probe") & all_near()).select("key", "id").join(text.select("id", "at"), "id")
        index = full.filter("not probe").select("key", "id").join(text.select("id", "at"), "id")
        for late, early in ((ends, index), (index, ends)):
            least = early.groupBy("key").agg(F.min("at").alias("least"))
            settled.append(materialize(late.join(least, "key").filter("at > least").select("at").distinct(), "settled"))
        on = full.filter(~F.col("probe") | ~all_near())
        if on.filter("probe").isEmpty():
            return cold, settled
        state = on.drop("full").join(lines.drop("length"), "id")


def near_rows(first: DataFrame, docs: DataFrame, keys_of: list[tuple[Column, list[int]]], budgets: tuple[tuple[int, int], ...]) -> DataFrame:
    """Places (at) of first occurrences that are within the edits of a line whose first occurrence is earlier.

    ``first(id, h1, h2, at, length, ...)`` has a row for each distinct line; ``keys_of`` has for each budget an array of a line's
    keys and what they are. Keys that only one line has go first, so that texts and letter counts are needed of lines with a
    partner only.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    for b, ((low, edits), (keys, place_of)) in enumerate(zip(budgets, keys_of, strict=True)):
        high = budgets[b + 1][0] if b + 1 < len(budgets) else None
        size = F.col("length")
        reach = (size >= low) if high is None else (size >= low) & (size < high + edits)
        each = first.filter(reach).select("id", "length", F.posexplode(keys).alias("n", "key"))
        delta = F.element_at(F.array(*[F.lit(p) for p in place_of]), F.col("n") + 1)
        each = each.withColumn("delta", delta)
        found = size - F.greatest("delta", F.lit(0))  # length of the shorter line, which the budget is by
        each = each.filter((found >= low) if high is None else (found >= low) & (found < high))
        # one number for what a key is: below zero an index key (and look-up) of budget -1 - code, else 4 x budget + delta
        parts.append(each.select("id", "key", F.when(F.col("delta") < 0, -1 - b).otherwise(4 * b + F.col("delta")).alias("code")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # keys of very many lines, found in a sample: they are full, and no task is to hold all lines of one
    in_index = F.col("code") < 0
    seen = rows.filter(in_index & (F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count("*").alias("i"))
    common = materialize(seen.filter(F.col("i") >= COMMON).select("key"), "common-keys")
    same = Window.partitionBy("key")
    n_index = F.count_if(in_index).over(same)
    other = (F.min("id").over(same) != F.max("id").over(same)) & (n_index > 0)
    rest = rows if common.isEmpty() else rows.join(common, "key", "left_anti")
    live = rest.repartition(tasks, "key").select("id", "key", "code", other.alias("other"), (n_index > FULL).alias("full")).filter("other").drop("other")
    if rest is not rows:
        live = live.unionByName(rows.join(common, "key", "left_semi").select("id", "key", "code", F.lit(True).alias("full")))
    budget = F.when(in_index, -1 - F.col("code")).otherwise(F.floor(F.col("code") / 4)).cast("int")
    as_index, as_probe = F.struct(F.lit(False).alias("probe"), F.lit(-1).alias("delta")), F.struct(F.lit(True).alias("probe"), F.when(in_index, 0).otherwise(F.col("code") % 4).alias("delta"))
    live = live.select("id", "key", "full", budget.alias("budget"), F.inline(F.when(in_index, F.array(as_index, as_probe)).otherwise(F.array(as_probe))))
    live = materialize(live, "live-keys")
    columns = ("id", "key", "budget", "probe", "delta")
    wanted = materialize(first.select("id", "at", "h1", "h2").join(live.select("id").distinct(), "id", "left_semi"), "wanted")
    small = (lambda df: F.broadcast(df)) if wanted.count() <= BROADCAST_LINES else (lambda df: df)
    holders = wanted.select(F.col("at.doc_id").alias("_id"), F.col("at.tag").alias("_tag")).distinct()
    texts = docs.select("doc_id", "text").join(small(holders), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_tag(F.col("text")) == F.col("_tag")), "left_semi")
    found = split_lines(texts).withColumns(same_line(F.col("line"))).join(small(wanted.select("h1", "h2", "id")), ["h1", "h2"])
    text = found.groupBy("id").agg(F.min(F.struct(place().alias("at"), "line")).alias("l")).select("id", "l.at", "l.line")
    text = materialize(text.withColumn("length", F.length("line")).withColumn("sig", signature(F.col("line"), F.col("length"))), "live-lines")
    cold, settled = [live.filter("not full").select(*columns)], []
    full = live.filter("full").select("id", "budget", "probe", "delta")
    if not full.isEmpty():
        more, settled = split_full(full, text, budgets)
        cold += more
    candidates = cold[0]
    for c in cold[1:]:
        candidates = candidates.unionByName(c)
    signed = candidates.join(text.select("id", "sig"), "id")
    index = signed.filter("not probe").select("key", F.col("id").alias("i_id"), F.col("sig").alias("i_sig"))
    probe = signed.filter("probe").select("key", "budget", "delta", F.col("id").alias("p_id"), F.col("sig").alias("p_sig"))
    # lines of equal length find each other both ways; one is enough
    apart = (F.col("p_id") != F.col("i_id")) & ((F.col("delta") > 0) | (F.col("i_id") < F.col("p_id")))
    edits = F.element_at(F.array(*[F.lit(e) for _, e in budgets]), F.col("budget") + 1)
    pairs = probe.join(index, "key").filter(apart & (count_distance(F.col("i_sig"), F.col("p_sig")) <= 2 * edits))
    pairs = pairs.select("i_id", "p_id", "budget").distinct()
    a = text.select(F.col("id").alias("i_id"), F.col("at").alias("i_at"), F.col("line").alias("a"))
    b = text.select(F.col("id").alias("p_id"), F.col("at").alias("p_at"), F.col("line").alias("b"))
    # the alignments take time rather than space: deal them out evenly, in a table, as filters move before a repartition
    pairs = materialize(pairs.join(a, "i_id").join(b, "p_id").repartition(tasks), "aligned")
    near = [pairs.filter((F.col("budget") == k) & (banded_distance(F.col("a"), F.col("b"), e) <= e)).select(F.greatest("i_at", "p_at").alias("at")) for k, (_, e) in enumerate(budgets)]
    for s in settled:
        near.append(s)
    out = near[0]
    for n in near[1:]:
        out = out.unionByName(n)
    return out.distinct()


def removed_lines(docs: DataFrame, budgets: tuple[tuple[int, int], ...] = BUDGETS) -> DataFrame:
    """(doc_id, tag, removed): sorted positions of the lines to remove, for texts that lose any."""
    if any(not 0 <= e <= 2 for _, e in budgets) or list(budgets) != sorted(budgets):
        raise ValueError("budgets are (least length, edits) by rising length, with two edits at most")
    budgets = tuple((low, e) for low, e in budgets if e)
    docs = docs.select("doc_id", "text")
    lines = split_lines(docs).withColumns(same_line(F.col("line")))
    long = lines.withColumn("length", F.length("line"))
    # lines under the budgets before the last are short: their texts are kept, and their keys made of distinct lines
    bounds = F.lit(False)
    for (low, e), (high, _) in zip(budgets, budgets[1:], strict=False):
        bounds = bounds | ((F.col("length") >= low) & (F.col("length") < high + e))
    # conditions around the keys would make the generated code too long to be compiled; what does not apply goes later
    keys, last = line_keys(F.col("line"), F.col("length"), budgets[-1][1]) if budgets else ([], [])
    hashed = long.select(place().alias("at"), "h1", "h2", "length", F.when(bounds, F.col("line")).alias("short"), F.array(*keys).alias("keys"))
    # equal lines have equal lengths and keys: any of their rows will do
    first = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("length", "short", "keys")])
    first = materialize(first.withColumn("id", F.monotonically_increasing_id()), "first-lines")
    keys_of = []
    for _, e in budgets[:-1]:
        some, what = line_keys(F.col("short"), F.col("length"), e)
        keys_of.append((F.array(*some), what))
    keys_of.append((F.col("keys"), last))
    stays = first.select("h1", "h2", F.col("at").alias("first"))
    later = lines.select("h1", "h2", place().alias("at")).join(stays, ["h1", "h2"]).filter("at <> first").select("at")
    if budgets:
        later = later.unionByName(materialize(near_rows(first, docs, keys_of, budgets), "near-lines"))
    return later.groupBy("at.doc_id", "at.tag").agg(F.array_sort(F.collect_set("at.pos")).alias("removed"))


def _with_removed(rows: DataFrame, docs: DataFrame, budgets: tuple[tuple[int, int], ...]) -> DataFrame:
    """``rows(doc_id, _tag, ...)`` with _removed, null where nothing goes."""
    gone = removed_lines(docs, budgets).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_its"), F.col("removed").alias("_removed"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_its")), "left")


def dedup(docs: DataFrame, budgets: tuple[tuple[int, int], ...] = BUDGETS) -> DataFrame:
    """doc_id, text (what is left of it), _row (all other columns) and _removed (positions, null for none) of every document.

    Null or empty text: kept as it is. Lines without a word always stay. A document keeps its row if all its lines go.
    Null doc_ids: each text by itself, after all others. Different texts of one doc_id are told apart and come in the order of a
    hash; equal rows keep the same lines. Very long texts and lines are read whole. No rows: no rows.
    """
    rows = _with_removed(packed(docs, "doc_id", "text").withColumn("_tag", text_tag(F.col("text"))), docs, budgets)
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select("doc_id", text.alias("text"), "_row", "_removed")


def report(docs: DataFrame, budgets: tuple[tuple[int, int], ...] = BUDGETS) -> DataFrame:
    """doc_id, n_removed and removed (comma-joined positions of removed lines, from 0) for every document.

    Null or empty text: nothing removed. Null, repeated and equal rows as in ``dedup``. No rows: no rows.
    """
    rows = _with_removed(docs.select("doc_id", text_tag(F.col("text")).alias("_tag")), docs, budgets)
    n = F.greatest(F.coalesce(F.size("_removed"), F.lit(0)), F.lit(0))
    return rows.select("doc_id", n.cast("long").alias("n_removed"), F.coalesce(F.array_join("_removed", ","), F.lit("")).alias("removed"))
