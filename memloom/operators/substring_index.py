"""A stored index for substring search: which rows have which three characters, and the rows to look at in the end.

Rows are versions by key (an ``UpsertLog``); grams are a table of (gram, key), in shards by gram. A search takes the rows that have
all grams of its pattern and tests the pattern on their newest texts, so grams of replaced texts cost a look and change
nothing. A pattern without three characters in a row is tested on all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.upsert_log import UpsertLog, parts
from memloom.operators.versions import Manifest

SHARDS = 32
GRAM = 3
#: Candidates up to which their keys stand in the plan as literals, which the Parquet reader can use.
LISTED = 2000
#: Grams that a task sorts, about.
PART_GRAMS = 1 << 20
GRAMS = "gram string, key string, shard int"


def grams_of(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none for shorter ones."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def pieces(pattern: str) -> list[str]:
    """The literal texts between the wildcards of an ILIKE pattern: % and _, each itself behind a backslash."""
    out, now, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            now, at = now + pattern[at + 1], at + 2
            continue
        if c in "%_":
            out, now = [*out, now], ""
        else:
            now += c
        at += 1
    return [p for p in [*out, now] if p]


def _shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


class SubstringIndex:
    """Texts by key under ``path``, found by what they contain."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.rows = UpsertLog(spark, f"{self.path}/rows", few=True)
        self.manifest = Manifest(spark, f"{self.path}/grams-manifest")
        #: Rows that the last search tested its pattern on; None if it tested all.
        self.tested: int | None = None

    def add(self, number: int, rows: DataFrame) -> None:
        """Add or replace ``rows(key, text)``, one for each key; a null text takes a key out. ``number`` counts batches up from 0.

        Grams are stored before rows, so that whatever row is there can be found; the same batch again changes nothing.
        """
        stamp = F.lit(f"{number:012d}")
        version, now = self.manifest.read()
        if str(number) not in now.get("batches", {}):
            name = uuid.uuid4().hex[:12]
            found = rows.select("key", F.explode(grams_of(F.col("text"))).alias("gram")).withColumn("shard", _shard(F.col("gram")))
            # a text has no more grams than characters
            about = parts(rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0, PART_GRAMS)
            # a gram of very many rows is dealt out by their keys
            found.repartitionByRange(about, "shard", "gram", "key").sortWithinPartitions("shard", "gram", "key").write.partitionBy("shard").parquet(f"{self.path}/grams/{name}")
            self.manifest.write(version + 1, {"batches": now.get("batches", {}) | {str(number): name}})
            self.manifest.prune()
        self.rows.append(rows.select("key", F.lit(number).cast("long").alias("seq"), stamp.alias("updated_at"), stamp.alias("created_at"), "text"), "rows", number)

    def search(self, pattern: str) -> DataFrame | None:
        """key and text of the rows that are ILIKE ``pattern``; None before the first batch."""
        wanted = pieces(pattern)
        grams = sorted({r.g for p in wanted for r in self.spark.createDataFrame([(p,)], "t string").select(F.explode(grams_of(F.col("t"))).alias("g")).collect()}) if any(len(p) >= GRAM for p in wanted) else []
        self.tested = None
        if not grams:
            rows = self.rows.table()
        else:
            names = self.manifest.read()[1].get("batches", {}).values()
            table = None
            for name in names:
                part = self.spark.read.schema(GRAMS).parquet(f"{self.path}/grams/{name}").filter(F.col("shard").isin(*[_shard(F.lit(g)) for g in grams]) & F.col("gram").isin(*grams))
                table = part if table is None else table.unionByName(part)
            if table is None:
                return None
            # each gram is counted once for a key, in however many batches it came
            dealt = table.select("gram", "key").repartition(parts(table.count()), "key")
            keys = dealt.distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("key")
            few = [r.key for r in keys.limit(LISTED + 1).collect()]
            if len(few) <= LISTED:
                self.tested = len(few)
                rows = self.rows.lookup(few) if few else self.rows.lookup([""])
            else:
                rows = self.rows.table(keys)
                self.tested = keys.count()
        return rows.filter(F.col("text").ilike(pattern)).select("key", "text") if rows is not None else None

    def counts(self) -> tuple[int, int]:
        """Rows that are there and batches of grams: many small batches are worth merging by a new index."""
        rows = self.rows.table()
        return (rows.filter("text is not null").count() if rows is not None else 0, len(self.manifest.read()[1].get("batches", {})))
