"""Entities: resolution of names, alias maps, assembly from resolutions, near-duplicates, split assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.ledger import not_excluded

#: Names that are never resolved.
STOP_NAMES = ("user", "assistant", "the user", "the assistant", "ai", "the model", "the system", "it", "this", "that")


def resolve_names(queries: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The entity that each ``queries(name)`` means: name, entity_id, tier.

    Tier 1: canonical name; 2: canonical name whose first words are the query; 3: alias. Within a tier the most
    mentioned entity, then the least id. Case does not matter. All three tiers are equi-joins: a canonical name is
    looked up under each of its word prefixes.
    """
    q = queries.select("name", F.lower(F.trim("name")).alias("q")).distinct()
    e = entities.select("entity_id", "mentions", F.lower("canonical").alias("c"))
    words = F.split("c", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))
    exact = e.select(F.col("c").alias("q"), "entity_id", "mentions", F.lit(1).alias("tier"))
    prefix = e.filter(F.size(words) > 1).select(F.explode(prefixes).alias("q"), "entity_id", "mentions", F.lit(2).alias("tier"))
    alias = aliases.join(entities.select("entity_id", "mentions"), "entity_id").select(F.lower("alias").alias("q"), "entity_id", "mentions", F.lit(3).alias("tier"))
    best = F.min(F.struct("tier", (-F.col("mentions")).alias("m"), "entity_id"))
    found = q.join(exact.unionByName(prefix).unionByName(alias), "q").groupBy("name").agg(best.alias("b"))
    return found.select("name", "b.entity_id", "b.tier")


def alias_map(mentions: DataFrame, aliases: DataFrame, split_map: DataFrame | None = None) -> DataFrame:
    """(mention id, entity_id): mentions whose lower-case name is an alias of exactly one entity; ``split_map(id, entity_id)`` overrides."""
    owned = aliases.groupBy(F.lower("alias").alias("a")).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("auto")).filter("n = 1")
    rows = mentions.select("id", F.lower("name").alias("a")).join(owned.select("a", "auto"), "a", "left")
    if split_map is None:
        return rows.filter("auto is not null").select("id", F.col("auto").alias("entity_id"))
    rows = rows.join(split_map.withColumnRenamed("entity_id", "split"), "id", "left")
    return rows.select("id", F.coalesce("split", "auto").alias("entity_id")).filter("entity_id is not null")


def entity_list(entities: DataFrame, entity_map: DataFrame, limit: int = 300) -> DataFrame:
    """Entities with the number of mapped mentions, the most mentioned first."""
    mapped = entity_map.groupBy("entity_id").agg(F.count_distinct("id").alias("mapped"))
    rows = entities.join(mapped, "entity_id", "left").withColumn("mapped", F.coalesce("mapped", F.lit(0)))
    return rows.orderBy(F.col("mentions").desc(), "entity_id").limit(max(1, min(limit, 2000)))


def normal_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def assemble(resolutions: DataFrame) -> DataFrame:
    """Entities from resolutions(seq, name, canonical, type, skip, mentions, split: array<string>).

    Skipped rows go. A split name gives each of its parts the integer share of its mentions and, without a type, a
    person. Rows with the same canonical name, but for case and white space, are one entity: mentions add up,
    aliases unite, the last type and spelling win.
    """
    parts = F.when(F.size(F.coalesce("split", F.array().cast("array<string>"))) > 0, F.col("split")).otherwise(F.array(F.coalesce("canonical", "name")))
    rows = resolutions.filter(~F.coalesce("skip", F.lit(False))).withColumn("n_parts", F.size(parts)).withColumn("part", F.explode(parts))
    rows = rows.withColumn("share", F.expr("mentions div n_parts")).withColumn("kind", F.coalesce("type", F.when(F.size("split") > 0, "person").otherwise("topic")))
    out = rows.groupBy(normal_name(F.col("part")).alias("key")).agg(
        F.max_by("part", "seq").alias("canonical"), F.max_by("kind", "seq").alias("type"), F.sum("share").alias("mentions"), F.array_sort(F.collect_set("name")).alias("aliases")
    )
    return out.select("key", "canonical", "type", "mentions", "aliases")


def near_duplicate_names(entities: DataFrame, most: int = 8) -> DataFrame:
    """Pairs of canonical names of which one contains the other and is at most ``most`` characters longer.

    A contained name starts at one of the longer name's characters, so each name is looked up under the substrings
    of the other that are up to ``most`` characters shorter: an equi-join instead of all pairs.
    """
    n = entities.select("entity_id", F.lower("canonical").alias("c"), F.length("canonical").alias("len"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.col("len") - 1)), lambda k: F.transform(F.sequence(F.lit(1), k + 1), lambda at: F.substring(F.col("c"), at, F.col("len") - k))))
    longer = n.select(F.col("entity_id").alias("long_id"), F.explode(F.array_distinct(cuts)).alias("c"))
    pairs = longer.join(n.select("c", F.col("entity_id").alias("short_id")), "c").filter("long_id <> short_id")
    return pairs.select(F.least("long_id", "short_id").alias("a"), F.greatest("long_id", "short_id").alias("b")).distinct()


def assign_splits(vectors: DataFrame, centroids: DataFrame, rows_bound: int = 10_000) -> DataFrame:
    """The most similar centroid of each vector: id, canonical, similarity (cosine with a small guard).

    Every vector meets every centroid: the centroids are a stated set, worked through in blocks of ``rows_bound``. A block is
    a matrix of unit rows, and a batch of vectors meets it in one product; the best of each block is kept.
    """
    blocks = centroids.count() // rows_bound + 1
    best = None
    for b in range(blocks):
        rows = centroids.filter(F.pmod(F.hash("canonical"), F.lit(blocks)) == b).select("canonical", "embedding").orderBy("canonical").collect()
        if rows:
            now = _nearest(vectors, [r.canonical for r in rows], np.array([r.embedding for r in rows], float))
            best = now if best is None else best.unionByName(now)
    if best is None:
        return vectors.select("id", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("double").alias("similarity")).limit(0)
    return best.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("s"), "canonical")).alias("m")).select("id", "m.canonical", (-F.col("m.s")).alias("similarity"))


def _nearest(vectors: DataFrame, names: list[str], centres: np.ndarray) -> DataFrame:
    unit = centres / (np.sqrt((centres * centres).sum(1)) + 1e-9)[:, None]
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            sims = np.round((x @ unit.T) / (np.sqrt((x * x).sum(1)) + 1e-9)[:, None], 9)
            at = sims.argmax(1)  # names are in order, so the first of equals is the least
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sims[np.arange(len(at)), at]), pa.array([names[i] for i in at], pa.string())], names=["id", "s", "canonical"])

    return vectors.select("id", "embedding").mapInArrow(run, f"id {kind}, s double, canonical string")


def candidate_contexts(mentions: DataFrame, tier1: int = 180, tier2: int = 350, batch: int = 20, contexts: int = 12, prefix: int = 50, cut: int = 180) -> DataFrame:
    """Names to resolve with their contexts: name, n, rank, tier, batch, contexts.

    Generic names are left out; the most frequent names come first. A name's contexts are those with distinct
    beginnings, the first ``contexts`` of them, cut to ``cut`` characters. One name is ranked by its own count only:
    ranks come from a top-k, so no window spans all names.
    """
    m = mentions.withColumn("key", F.lower(F.trim("name"))).filter(~F.col("key").isin(*STOP_NAMES))
    top = m.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(tier2)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "key")))
    ranked = ranked.withColumn("tier", F.when(F.col("rank") <= tier1, 1).otherwise(2)).withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("int"))
    start = F.lower(F.substring("context", 1, prefix))
    first = m.join(F.broadcast(ranked.select("key")), "key").groupBy("key", start.alias("start")).agg(F.min(F.struct("id", F.substring("context", 1, cut).alias("c"))).alias("f"))
    some = first.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("f.id"))).filter(F.col("at") <= contexts)
    texts = some.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "f.c"))), lambda x: x["c"]).alias("contexts"))
    return ranked.join(texts, "key").select(F.col("key").alias("name"), "n", "rank", "tier", "batch", "contexts")


def quoted(c: Column) -> Column:
    """A text as a pattern that matches itself."""
    return F.regexp_replace(c, r"([\\\[\]{}()*+?.^$|])", r"\\$1")


def aboutness(found: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row (entity_id, pattern): any of an entity's names as a whole word: canonical, without its brackets, each alias."""
    name = entities.join(F.broadcast(found.select("entity_id")), "entity_id", "left_semi").select("entity_id", F.explode(F.array(F.lower("canonical"), F.lower(F.trim(F.split_part(F.col("canonical"), F.lit(" ("), F.lit(1)))))).alias("t"))
    other = aliases.join(F.broadcast(found.select("entity_id")), "entity_id", "left_semi").select("entity_id", F.lower("alias").alias("t"))
    terms = name.unionByName(other).filter("t <> ''").groupBy("entity_id").agg(F.array_sort(F.collect_set(quoted(F.col("t")))).alias("terms"))
    return terms.select("entity_id", F.concat(F.lit(r"(?i)\b(?:"), F.array_join("terms", "|"), F.lit(r")\b")).alias("pattern"))


def timeline(name: str, entities: DataFrame, aliases: DataFrame, mapped: DataFrame, assertions: DataFrame, conversations: DataFrame, speaker: str = "", limit: int = 25) -> DataFrame:
    """What was said about an entity, oldest first: day, type, speaker, statement (cut), ref (conversation#message).

    Assertions of the entity's chunks that name it, by any of its names, as a whole word. Conversations of excluded owners
    are left out; equal statements of one conversation are one entry.
    """
    found = resolve_names(entities.sparkSession.createDataFrame([(name,)], "name string"), entities, aliases)
    of = mapped.join(F.broadcast(found), "entity_id", "left_semi").select("conv_key", "chunk_idx").distinct()
    shown = conversations.filter(not_excluded()).select("conv_key", "created_at")
    rows = assertions.drop("created_at").join(of, ["conv_key", "chunk_idx"], "left_semi").join(shown, "conv_key")
    speaker = speaker.lower().strip()
    speaker = {"agent": "assistant"}.get(speaker, speaker)
    if speaker in ("user", "assistant", "both"):
        rows = rows.filter(F.col("speaker") == speaker)
    rows = rows.crossJoin(F.broadcast(aboutness(found, entities, aliases).select("pattern"))).filter(F.regexp_like(F.coalesce("statement", F.lit("")), F.col("pattern")))
    ref = F.when(F.size("evidence") > 0, F.concat("conv_key", F.lit("#"), F.element_at("evidence", 1)))
    rows = rows.select("created_at", "type", "speaker", "statement", "conv_key", "evidence", ref.alias("ref")).distinct()
    top = rows.orderBy(F.col("created_at").asc_nulls_first(), "conv_key", "ref", "type", "statement").limit(max(1, min(limit, 60)))
    return top.select(F.coalesce(F.substring("created_at", 1, 10), F.lit("?")).alias("day"), "type", "speaker", F.substring("statement", 1, 180).alias("statement"), "ref")


def build_entities(listed: DataFrame, mentions: DataFrame, split_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, map) from ``listed(seq, canonical, type, mentions, aliases)``, all anew.

    An entity's id is its place in the list; of equal canonical names the last takes splits. Mentions map by aliases of one
    entity only; ``split_map(id, canonical)`` overrides where it names an entity.
    """
    entities = listed.select(F.col("seq").cast("long").alias("entity_id"), "canonical", "type", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))
    aliases = listed.select(F.explode("aliases").alias("alias"), F.col("seq").cast("long").alias("entity_id")).distinct()
    last = entities.groupBy("canonical").agg(F.max("entity_id").alias("entity_id"))
    return entities, aliases, alias_map(mentions, aliases, split_map.join(last, "canonical").select("id", "entity_id"))


def chunk_mentions(mentions: DataFrame, entity_map: DataFrame, conversations: DataFrame) -> DataFrame:
    """Mapped mentions of known conversations: id, conv_key, chunk_idx, entity_id, day of the conversation."""
    rows = mentions.select("id", "conv_key", "chunk_idx").join(entity_map.select("id", "entity_id"), "id")
    return rows.join(conversations.select("conv_key", F.substring("created_at", 1, 10).alias("day")), "conv_key").select("id", "conv_key", "chunk_idx", "entity_id", "day")
