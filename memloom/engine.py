"""The tools and main routes of the service as methods, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import Porter, stemmed_tokens
from memloom.operators import communities, edges, ledger, resolve, search
from memloom.operators.text_index import TextIndex


@dataclass
class MemoryEngine:
    """Queries over one set of tables; ``tables`` maps a name to its DataFrame.

    With an ``index`` of the messages (``message_index``) keywords are looked up there; without one texts are read.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    index: TextIndex | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def search_memory(self, query: str, vector: list[float] | None = None, source: str = "", after: str = "", before: str = "", limit: int = 8, excerpt: int = 300) -> DataFrame:
        """Fused keyword and vector hits with an excerpt; without a vector, keywords only."""
        after, before = ledger.date_bounds(after, before)
        keep = ledger.not_excluded()
        for on, test in ((source, F.col("source") == source), (after, F.col("created_at") >= after), (before, F.col("created_at") <= before)):
            keep = keep & test if on else keep
        keys = ["conv_key", "native_id"]
        if self.index is None:
            words = search.keyword_search(self["messages"], query, keys, stemmed_tokens(F.col("text")), 25, keep)
        else:
            words = self.index.search(query, 25, self["messages"].filter(keep).select(*keys))
        lists, orders = [words], [[F.col("score").desc(), *map(F.col, keys)]]
        if vector is not None:
            lists.append(search.knn(self["vectors"], vector, keys, 25, keep))
            orders.append([F.col("sim").desc(), *map(F.col, keys)])
        fused = search.rrf(lists, orders, keys, limit=limit)
        return F.broadcast(fused).join(self["messages"].select(*keys, "role", "created_at", F.substring("text", 1, excerpt).alias("excerpt")), keys).orderBy(F.col("score").desc(), *keys)

    @staticmethod
    def message_index(spark: SparkSession, path: str) -> TextIndex:
        """The index of messages under ``path``: add new and changed messages to it as they are stored, remove deleted ones."""
        return TextIndex(spark, path, ["conv_key", "native_id"], stemmed_tokens, Porter.stem)

    def get_conversation(self, ref: str, window: int = 6) -> DataFrame:
        key, _, native = ref.partition("#")
        path = self["messages"].filter((F.col("conv_key") == key) & F.col("on_active_path") & ledger.not_excluded(keep_null=True))
        hits = self.spark.createDataFrame([(key, native or None)], "conv_key string, native_id string")
        return search.within_budget(search.context_window(path, hits, window).drop("hit")).orderBy("pos")

    def get_message(self, ref: str, part: int = 1) -> DataFrame:
        key, _, native = ref.partition("#")
        rows = self["messages"].filter((F.col("conv_key") == key) & (F.col("native_id") == native) & ledger.not_excluded(keep_null=True))
        return search.parts(rows).filter(F.col("part") == F.least(F.greatest(F.lit(part), F.lit(1)), F.col("n_parts")))

    def list_conversations(self, after: str = "", before: str = "", source: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
        return ledger.browse(self["conversations"], after, before, source, limit, offset)

    def record(self, key: str) -> DataFrame:
        return self["conversations"].filter((F.col("conv_key") == key) & ledger.not_excluded(keep_null=True))

    def entity_neighborhood(self, entity: str, limit: int = 15) -> DataFrame:
        return edges.neighbourhood_of(self["edges"], self["entities"], self._resolve(entity), limit)

    def entity_timeline(self, entity: str, limit: int = 25, speaker: str = "") -> DataFrame:
        return resolve.timeline(entity, self["entities"], self["aliases"], self["mentions"], self["assertions"], self["conversations"], speaker, limit)

    def what_connects(self, a: str, b: str) -> DataFrame:
        ends = self._resolve(a).withColumn("side", F.lit("a")).unionByName(self._resolve(b).withColumn("side", F.lit("b")))
        return edges.what_connects(self["edges"], self["entities"], ends)

    def list_themes(self) -> DataFrame:
        return self["communities"].orderBy(F.col("size").desc(), "community_id")

    def theme_of(self, entity: str) -> DataFrame:
        mine = self["members"].join(F.broadcast(self._resolve(entity)), "entity_id", "left_semi")
        near = self["members"].join(mine.select("community_id").distinct(), "community_id", "left_semi")
        return communities.theme_members(near, self["entities"], 20)

    def memory_status(self) -> DataFrame:
        return ledger.freshness(self["conversations"])

    def edges_for_typing(self, min_weight: int = 2, limit: int = 200, offset: int = 0, only_untyped: bool = True) -> DataFrame:
        return edges.typing_page(self["edges"], self["entities"], self["mentions"], self["assertions"], self["aliases"], min_weight, limit, offset, only_untyped)

    def set_edge_types(self, typings: DataFrame) -> DataFrame:
        """The edges under new typings; write them back as the table of edges."""
        return edges.apply_typings(self["edges"].drop("verified_relation", "direction", "temporality", "as_of", "verified", "verified_at"), typings)

    def full_graph(self, min_weight: int = 3) -> tuple[DataFrame, DataFrame]:
        links, nodes = edges.feed(self["edges"], self["entities"], min_weight)
        return links, edges.feed_nodes(nodes, self["communities"], self["members"])

    def build_entities(self, listed: DataFrame, split_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        return resolve.build_entities(listed, self["mentions"], split_map)

    def claim_job(self, now: Column, worker: str = "anon") -> DataFrame:
        return ledger.claim(self["jobs"], self["conversations"], now, worker)

    def complete_jobs(self, outcomes: DataFrame) -> DataFrame:
        return ledger.complete(self["jobs"], outcomes)

    def ledger_status(self) -> tuple[DataFrame, DataFrame]:
        return ledger.queue_status(self["jobs"]), ledger.ledger_totals(self["mentions"], self["assertions"], self["extractions"])

    def stats(self) -> DataFrame:
        return ledger.source_stats(self["conversations"])

    def _resolve(self, name: str) -> DataFrame:
        return resolve.resolve_names(self.spark.createDataFrame([(name,)], "name string"), self["entities"], self["aliases"]).select("entity_id")
