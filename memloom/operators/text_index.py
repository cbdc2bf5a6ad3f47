"""A stored keyword index: positional postings in segments, searched without reading texts.

A segment has two tables. ``docs``: a number, a block and a length for each row, with its keys. ``postings``: for each term and
block the rows, the greatest count and the least length, which bound a row's score, and lists of the numbers, lengths and counts of
these rows and of all the term's places in them; in shards by term, sorted by term and block, so that Parquet statistics leave out
what a query does not ask for. Words are dealt out by blocks in parts of about ``PART_WORDS``, and lists are made, sorted and written
where a block's words are: no packed row is shuffled. Rows that come again, or go, are listed as ``gone`` with the segment that replaced them; ``merge`` makes one segment of
all. What belongs to the index is named in a manifest, so readers see a segment whole or not at all.

Numbers count up within a writing task, so documents are numbered without a shuffle, and a block is a run of numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import Op, Phrase, QueryError, matches, parse_query, phrases_of, query_words, scored_starts, tokens
from memloom.operators.search import K1, B, idf
from memloom.operators.tables import delete, stored
from memloom.operators.versions import Manifest

#: Numbers of a block, as bits, and folders that the terms of a segment are dealt into.
BLOCK_BITS, SHARDS = 10, 32
#: Blocks that are scored before any other is judged by what they gave; each round takes four times as many as the one before.
FIRST_BLOCKS = 16
#: Blocks and terms up to which they stand in the plan as literals, which the Parquet reader can use.
LISTED = 500


def plain_words(tree) -> bool:
    """Whether a query is made of single whole words with AND and OR, so that a block's bound can be told from its words."""
    if isinstance(tree, Phrase):
        return len(tree.words) == 1 and not tree.prefix
    return isinstance(tree, Op) and tree.kind in ("AND", "OR") and plain_words(tree.left) and plain_words(tree.right)


def holds(tree, present: dict[str, Column]) -> Column:
    """Whether a query of plain words is true, from which of its words are there."""
    if isinstance(tree, Phrase):
        return present[tree.words[0]]
    left, right = holds(tree.left, present), holds(tree.right, present)
    return left & right if tree.kind == "AND" else left | right


def true_of_nothing(tree) -> bool:
    """Whether a query holds for a row without any of its words: phrases without words restrict nothing."""
    if isinstance(tree, Op):
        left, right = true_of_nothing(tree.left), true_of_nothing(tree.right)
        return {"AND": left and right, "OR": left or right, "NOT": left and not right}[tree.kind]
    return not any(p.words for p in (tree.phrases if hasattr(tree, "phrases") else (tree,)))


def _part(frequency: Column, length: Column, average: float) -> Column:
    return frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length / F.lit(average)))


PACKED = "term string, block long, n int, most int, shortest int, docs array<long>, lens array<int>, places array<array<int>>"
POSTINGS = f"{PACKED}, seg string, shard int"
#: Texts that are packed at a time.
PACK_ROWS = 1 << 10
#: Words of the texts, about, whose packed rows a task sorts and writes.
PART_WORDS = 1 << 22
#: Blocks with rows that are gone up to which the list of them is broadcast, some 300 bytes each.
BROADCAST_BLOCKS = 100_000


def _pack(bits: int):
    """Arrow batches of (doc, len, w) as packed rows, one for each term and block of a batch."""

    def lists(values, starts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)

    def new(*keys: np.ndarray) -> np.ndarray:
        """Where any of the keys begins a new run."""
        other = np.zeros(max(len(keys[0]) - 1, 0), bool)
        for k in keys:
            other |= k[1:] != k[:-1]
        return np.flatnonzero(np.append(True, other)) if len(keys[0]) else np.zeros(0, np.int64)

    def pack(part: pa.RecordBatch) -> pa.RecordBatch:
        words = part.column("w")
        owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(words).dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        doc, length = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "len"))
        at = (np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(doc)))[owner] + 1).astype(np.int32)
        order = np.argsort(term.astype(np.uint16) if len(coded.dictionary) < 1 << 16 else term, kind="stable")
        term, owner, at = term[order], owner[order], at[order]
        row = new(term, owner)  # a term in a text
        block = doc[owner[row]] >> bits
        run = new(term[row], block)  # a term in a block
        counts, lens = np.diff(np.append(row, len(term))).astype(np.int32), length[owner[row]]
        bounds = [np.maximum.reduceat(counts, run), np.minimum.reduceat(lens, run)] if len(run) else [counts, lens]
        n = np.diff(np.append(run, len(row))).astype(np.int32)
        columns = [coded.dictionary.take(pa.array(term[row[run]])), pa.array(block[run]), pa.array(n), *map(pa.array, bounds)]
        return pa.RecordBatch.from_arrays([*columns, lists(pa.array(doc[owner[row]]), run), lists(pa.array(lens), run), lists(lists(pa.array(at), row), run)], [x.split()[0] for x in PACKED.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                yield pack(batch.slice(at, PACK_ROWS))

    return each


def unpacked(rows: DataFrame) -> DataFrame:
    """(term, seg, block, doc, len, at) of packed rows: one for each text that has the term."""
    return rows.select("term", "seg", "block", F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("lens").alias("len"), F.col("places").alias("at"))))


def _shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


class TextIndex:
    """An index under ``path`` over rows with ``keys``; ``toks`` makes an array of tokens of the column text."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], toks, stem=str) -> None:
        self.spark, self.path, self.keys, self.toks, self.stem = spark, path.rstrip("/"), keys, toks, stem
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        #: Blocks of the last search: those that its words occur in, and those whose postings it read.
        self.blocks_there = self.blocks_read = 0

    # writing

    def add(self, rows: DataFrame) -> str | None:
        """Index ``rows(keys, text)``, one row for each key; rows of known keys replace what was there. The name of the segment."""
        return self._commit(rows, rows.select(*self.keys))

    def remove(self, gone: DataFrame) -> None:
        """Take the rows with these keys out of the index."""
        self._commit(None, gone.select(*self.keys))

    def _commit(self, rows: DataFrame | None, touched: DataFrame) -> str:
        version, now = self.manifest.read()
        name = uuid.uuid4().hex[:12]
        if now.get("segments"):
            old = self._live(now).join(touched.distinct(), self.keys, "left_semi").select("seg", "doc", "block", "len")
            old.write.parquet(f"{self.path}/gone/{name}")
        if rows is not None:
            self._write(name, rows)
        kept = {"segments": [*now.get("segments", []), *([name] if rows is not None else [])], "gone": [*now.get("gone", []), *([name] if now.get("segments") else [])]}
        kinds = {k: touched.schema[k].dataType.simpleString() for k in self.keys}
        shape = ", ".join(f"`{k}` {kind}" for k, kind in kinds.items())
        self.manifest.write(version + 1, {"keys": kinds, "docs": f"{shape}, len int, doc long, block long, seg string"} | now | kept)
        return name

    def _write(self, name: str, rows: DataFrame) -> None:
        doc = F.monotonically_increasing_id()
        words = rows.select(*self.keys, F.inline(F.transform(F.array(self.toks(F.col("text"))), lambda t: F.struct(F.coalesce(t, F.array().cast("array<string>")).alias("w")))))
        numbered = words.select(*self.keys, F.size("w").alias("len"), "w", doc.alias("doc"))
        # numbers must not change between the tables, so they are made once
        base = f"{self.path}/segments/{name}"
        numbered.withColumn("block", F.shiftright("doc", BLOCK_BITS)).write.parquet(f"{base}/words")
        numbered = self.spark.read.schema(numbered.withColumn("block", F.lit(0).cast("long")).schema).parquet(f"{base}/words")
        numbered.drop("w").withColumn("seg", F.lit(name)).write.parquet(f"{base}/docs")
        parts = -(-(numbered.agg(F.sum("len")).first()[0] or 0) // PART_WORDS)
        # words are a fraction of their packed rows: they are dealt into parts, and no packed row is shuffled
        near = numbered.repartitionByRange(max(parts, 1), "block").sortWithinPartitions("doc")
        found = near.select("doc", "len", "w").mapInArrow(_pack(BLOCK_BITS), PACKED)
        self._write_postings(base, found.withColumn("seg", F.lit(name)))
        delete(self.spark, f"{base}/words")

    def _write_postings(self, base: str, packed: DataFrame) -> None:
        """Write packed rows in their shards, where they are: a term of very many rows is dealt out by its blocks."""
        rows = packed.withColumn("shard", _shard(F.col("term")))
        rows.sortWithinPartitions("shard", "term", "seg", "block").write.partitionBy("shard").parquet(f"{base}/postings")

    def merge(self) -> None:
        """One segment of all, without the rows that are gone; the old files go with ``vacuum``."""
        version, now = self.manifest.read()
        if not now.get("segments"):
            return
        name = uuid.uuid4().hex[:12]
        base = f"{self.path}/segments/{name}"
        self._live(now).write.parquet(f"{base}/docs")
        gone = self._gone(now)
        postings = self._table(now, "postings").drop("shard")
        self._write_postings(base, postings if gone is None else self._left(postings, gone))
        self.manifest.write(version + 1, now | {"segments": [name], "gone": []})

    def _left(self, postings: DataFrame, gone: DataFrame) -> DataFrame:
        """Packed rows without the rows that are gone, of which a block has a bit each, by 64 numbers."""
        word = gone.groupBy("seg", "block", F.shiftright("doc", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(doc & 63)))").alias("bits"))
        bits = stored(word.groupBy("seg", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_gone")), "gone")
        few = bits.count() <= BROADCAST_BLOCKS
        rows = postings.join(F.broadcast(bits) if few else bits, ["seg", "block"], "left")
        lists = F.arrays_zip("docs", "lens", "places")
        live = F.expr("filter(_z, x -> coalesce((shiftright(try_element_at(_gone, shiftright(x.docs, 6)), int(x.docs & 63)) & 1) = 0, true))")
        kept = F.when(F.col("_gone").isNull(), F.col("_z")).otherwise(live)
        rows = rows.withColumn("_z", lists).withColumn("_k", kept).filter(F.size("_k") > 0)
        most = F.array_max(F.transform("_k.places", F.size))
        return rows.select("term", "block", F.size("_k").alias("n"), most.alias("most"), F.array_min("_k.lens").alias("shortest"), F.col("_k.docs").alias("docs"), F.col("_k.lens").alias("lens"), F.col("_k.places").alias("places"), "seg")

    def vacuum(self) -> None:
        """Delete the folders that the current version does not name; searches that began before may fail."""
        _, now = self.manifest.read()
        jvm = self.spark.sparkContext._jvm
        for part, live in (("segments", now.get("segments", [])), ("gone", now.get("gone", []))):
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.listStatus(root) if fs.exists(root) else []:
                if status.getPath().getName() not in live:
                    fs.delete(status.getPath(), True)
        self.manifest.prune(1)

    # reading

    def _table(self, now: dict, part: str) -> DataFrame:
        paths = [f"{self.path}/segments/{s}/{part}" for s in now["segments"]]
        if part == "docs":
            return self.spark.read.schema(now["docs"]).parquet(*paths)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(POSTINGS).parquet(p) for p in paths])

    def _gone(self, now: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/gone/{g}" for g in now["gone"]]) if now.get("gone") else None

    def _live(self, now: dict) -> DataFrame:
        docs, gone = self._table(now, "docs"), self._gone(now)
        return docs if gone is None else docs.join(gone.select("seg", "doc"), ["seg", "doc"], "left_anti")

    def _of(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """Rows of some terms: their shards, and of these the row groups that can have them, are read."""
        return rows.filter(F.col("shard").isin(*[_shard(F.lit(w)) for w in words]) & F.col("term").isin(*words))

    def _beginning(self, now: dict, begin: str) -> DataFrame:
        """Postings of the terms with a beginning; their column tells which these are."""
        postings = self._table(now, "postings")
        terms = postings.filter(F.startswith("term", F.lit(begin))).select("term", "shard").distinct()
        few = [r.term for r in terms.limit(LISTED + 1).collect()]
        return self._of(postings, few) if len(few) <= LISTED else postings.join(terms, ["term", "shard"], "left_semi")

    def _without_gone(self, rows: DataFrame, now: dict) -> DataFrame:
        gone = self._gone(now)
        return rows if gone is None else rows.join(gone.select("seg", "doc"), ["seg", "doc"], "left_anti")

    def statistics(self, now: dict | None = None) -> tuple[int, float]:
        """Rows of the index and their mean length; both are sums over narrow tables."""
        now = now or self.manifest.read()[1]
        n, total = self._live(now).agg(F.count("*"), F.sum("len")).first()
        return n, (total or 0) / n if n else 0.0

    def search(self, query: str, limit: int = 25, among: DataFrame | None = None, on_error: str = "empty") -> DataFrame:
        """keys and score of the ``limit`` best rows, as ``keyword_search`` gives them over the same rows.

        ``among(keys)`` filters hits, not the statistics. Of a query of plain words only the blocks are read that can hold one of
        the best rows; of others the postings of the words that they name.
        """
        _, now = self.manifest.read()
        none = self.spark.createDataFrame([], f"{self._schema(now)}, score double") if now.get("segments") else None
        try:
            tree = parse_query(query, self.stem)
        except QueryError:
            words = " ".join(f'"{w}"' for w in tokens(query)) if on_error == "lenient" else ""
            tree = parse_query(words, self.stem) if words else None
        self.blocks_there = self.blocks_read = 0
        if tree is None or none is None:
            return none
        n, average = self.statistics(now)
        average = average or 1.0
        if plain_words(tree):
            return self._best(now, tree, n, average, limit, among)
        rows = self._found(now, tree)
        phrases = phrases_of(tree)
        starts = [F.size(scored_starts(F.col("kept"), *p)).alias(f"_f{i}") for i, p in enumerate(phrases)]
        rows = stored(rows.select("seg", "doc", "len", matches(F.col("kept"), tree).alias("_hit"), *starts), "found")
        stats = rows.agg(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(phrases))], F.count("*").alias("_"))
        hits = rows.filter("_hit").crossJoin(F.broadcast(stats))
        parts = [idf(F.lit(n), F.col(f"_d{i}")) * _part(F.col(f"_f{i}"), F.col("len"), average) for i in range(len(phrases))]
        return self._top(hits.select("seg", "doc", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score")), now, limit, among)

    def _schema(self, now: dict) -> str:
        return ", ".join(f"{k} {kind}" for k, kind in now["keys"].items())

    def _found(self, now: dict, tree) -> DataFrame:
        """seg, doc, len and kept of every live row with a word of the query, or of every row if one without can match."""
        whole, begins = query_words(tree)
        parts = [self._of(self._table(now, "postings"), whole)] if whole else []
        parts += [self._beginning(now, b) for b in begins]
        rows = unpacked(reduce(DataFrame.unionByName, [p.drop("shard") for p in parts] or [self._table(now, "postings").limit(0)]))
        if len(parts) > 1:  # a word may have several of the beginnings
            rows = rows.dropDuplicates(["seg", "doc", "term"])
        rows = self._without_gone(rows, now)
        word = F.transform("at", lambda i: F.struct(F.col("term").alias("w"), i.alias("at")))
        kept = rows.groupBy("seg", "doc", "len").agg(F.flatten(F.collect_list(word)).alias("kept"))
        if true_of_nothing(tree):
            kept = self._live(now).select("seg", "doc", "len").join(kept.drop("len"), ["seg", "doc"], "left")
            kept = kept.withColumn("kept", F.coalesce("kept", F.array().cast(kept.schema["kept"].dataType)))
        return kept

    def _best(self, now: dict, tree, n: int, average: float, limit: int, among: DataFrame | None) -> DataFrame:
        """The best rows of a query of plain words, by blocks: the greatest bounds first, in growing rounds, while a block can still matter."""
        words = [p.words[0] for p, _ in phrases_of(tree)]
        distinct = list(dict.fromkeys(words))
        packed = self._of(self._table(now, "postings"), distinct)
        blocks = stored(packed.select("term", "seg", "block", "n", "most", "shortest"), "blocks")
        postings = unpacked(packed).select("term", "seg", "block", "doc", "len", F.size("at").alias("tf"))
        df = {w: 0 for w in distinct} | {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        gone = self._gone(now)
        if gone is not None:
            lost = postings.join(gone.select("seg", "block").distinct(), ["seg", "block"], "left_semi").join(gone.select("seg", "doc"), ["seg", "doc"], "left_semi")
            for r in lost.groupBy("term").agg(F.count("*").alias("n")).collect():
                df[r.term] -= r.n
        worth = {w: words.count(w) for w in distinct}
        weight = {w: worth[w] * self._idf(n, df[w]) for w in distinct}
        bound = [F.max(F.when(F.col("term") == w, F.lit(weight[w]) * _part(F.col("most"), F.col("shortest"), average))).alias(f"_b{i}") for i, w in enumerate(distinct)]
        by_block = blocks.groupBy("seg", "block").agg(*bound)
        there = {w: F.col(f"_b{i}").isNotNull() for i, w in enumerate(distinct)}
        total = reduce(lambda a, b: a + b, [F.coalesce(f"_b{i}", F.lit(0.0)) for i in range(len(distinct))])
        by_block = stored(by_block.filter(holds(tree, there)).select("seg", "block", total.alias("bound")), "bounds")
        self.blocks_there = by_block.count()
        def scored(chosen: DataFrame) -> DataFrame:
            rows = self._without_gone(chosen, now)
            counts = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"_f{i}") for i, w in enumerate(distinct)]
            rows = rows.groupBy("seg", "doc", "len").agg(*counts)
            rows = rows.filter(holds(tree, {w: F.col(f"_f{i}").isNotNull() for i, w in enumerate(distinct)}))
            # summed in the order of the query's words, as the scan does
            parts = [F.lit(self._idf(n, df[w])) * _part(F.coalesce(F.col(f"_f{distinct.index(w)}"), F.lit(0)), F.col("len"), average) for w in words]
            return stored(rows.select("seg", "doc", reduce(lambda a, b: a + b, parts).alias("score")), "scores")

        best, edge, done, size = None, float("-inf"), [], FIRST_BLOCKS
        while True:
            # a bound is a sum of rounded terms: the least difference lets a block in
            open_ = by_block.filter(F.col("bound") >= F.lit(edge - 1e-9))
            open_ = open_.filter(~self._among(done))
            turn = [(r.seg, r.block) for r in open_.orderBy(F.col("bound").desc(), "seg", "block").limit(size).collect()]
            whole = len(done) + len(turn) > LISTED
            chosen = postings.join(open_.select("seg", "block"), ["seg", "block"], "left_semi") if whole else postings.filter(self._among(turn))
            self.blocks_read += open_.count() if whole else len(turn)
            if not turn and best is not None:
                return best.orderBy(F.col("score").desc(), *self.keys)
            more = self._top(scored(chosen), now, limit, among)
            best = stored(more if best is None else best.unionByName(more).orderBy(F.col("score").desc(), *self.keys).limit(limit), "best")
            scores = sorted((r.score for r in best.select("score").collect()), reverse=True)
            edge = scores[limit - 1] if len(scores) >= limit else edge
            if whole or len(turn) < size:
                return best.orderBy(F.col("score").desc(), *self.keys)
            done, size = done + turn, 4 * size

    @staticmethod
    def _idf(n: int, df: int) -> float:
        return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)

    @staticmethod
    def _among(blocks: list[tuple[str, int]]) -> Column:
        by: dict[str, list[int]] = {}
        for seg, block in blocks:
            by.setdefault(seg, []).append(block)
        return reduce(lambda a, b: a | b, [(F.col("seg") == s) & F.col("block").isin(b) for s, b in by.items()], F.lit(False))

    def _top(self, hits: DataFrame, now: dict, limit: int, among: DataFrame | None) -> DataFrame:
        """The best hits with their keys; without a filter only these meet the table of keys."""
        docs = self._table(now, "docs").select("seg", "doc", *self.keys)
        if among is not None:
            hits = hits.join(docs, ["seg", "doc"]).join(among.select(*self.keys).distinct(), self.keys, "left_semi")
            return hits.orderBy(F.col("score").desc(), *self.keys).limit(limit).select(*self.keys, "score")
        # all hits as good as the last one: the keys decide between equal scores
        edge = hits.orderBy(F.col("score").desc()).limit(limit).agg(F.min("score").alias("_edge"))
        best = hits.crossJoin(F.broadcast(edge)).filter(F.col("score") >= F.col("_edge")).drop("_edge")
        # numbers stand in order in the table of keys, so a few of them are found by its statistics
        few = best.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            docs = docs.filter(F.col("seg").isin(*{r.seg for r in few}) & F.col("doc").isin(*{r.doc for r in few}))
        return best.join(docs, ["seg", "doc"]).orderBy(F.col("score").desc(), *self.keys).limit(limit).select(*self.keys, "score")
