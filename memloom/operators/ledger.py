"""Worksheets, statistics, curation and queue state over mentions, assertions and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED = ("sealed",)


def not_excluded(keep_null: bool = False, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Filter on column owner; a null owner is dropped unless ``keep_null``."""
    owner = F.col("owner")
    return ~(F.coalesce(owner, F.lit("")) if keep_null else owner).isin(*excluded)


#: First and last moment of a day, as they follow a date.
DAY = ("T00:00:00", "T23:59:59.999999")


def date_bounds(after: str = "", before: str = "") -> tuple[str, str]:
    """Bounds of an interval; a date without a time covers its whole day."""
    return tuple(bound + edge * (len(bound) == len("2024-01-01")) for bound, edge in zip((after, before), DAY, strict=True))


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def browse(conversations: DataFrame, after: str = "", before: str = "", source: str = "", limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """Conversations that overlap an interval, the latest first."""
    after, before = date_bounds(after, before)
    tests = [not_excluded()]
    tests += [F.col("source") == source] if source else []
    tests += [F.col("updated_at") >= after] if after else []
    tests += [F.col("created_at") <= before] if before else []
    rows = conversations.filter(reduce(lambda a, b: a & b, tests))
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), "conv_key").offset(offset).limit(clamp(limit, most))


def mention_worksheet(mentions: DataFrame, conversations: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """Names by frequency: name (most frequent spelling, least on ties), n, n_conversations, kinds."""
    if conversations is not None:
        mentions = mentions.join(conversations.filter(not_excluded()).select("conv_key"), "conv_key", "left_semi")
    spelt = mentions.groupBy(F.lower("name").alias("key"), "name").agg(F.count("*").alias("k"))
    best = spelt.groupBy("key").agg(F.min(F.struct((-F.col("k")).alias("k"), "name"))["name"].alias("name"))
    rows = mentions.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("conv_key").alias("n_conversations"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return rows.join(best, "key").select("name", "n", "n_conversations", "kinds").orderBy(F.col("n").desc(), "name").limit(clamp(limit, 1000))


def with_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages of known conversations with source, owner and title: what searches filter by."""
    return messages.drop("source", "owner", "title").join(conversations.select("conv_key", "source", "owner", "title"), "conv_key")


def hydrate(hits: DataFrame, messages: DataFrame, conversations: DataFrame, cut: int = 300) -> DataFrame:
    """Ranked hits (conv_key, native_id, ...), a short list, with their message's role, date and excerpt, and their conversation."""
    keys = ["conv_key", "native_id"]
    rows = F.broadcast(hits).join(messages.select(*keys, "role", "created_at", F.substring("text", 1, cut).alias("excerpt")), keys)
    return rows.join(conversations.select("conv_key", "title", "source"), "conv_key")


def by_name(mentions: DataFrame, name: str) -> DataFrame:
    return mentions.filter(F.lower("name") == name.lower())


def like_pattern(query: str, raw_like: bool = False) -> str:
    """Pattern of a substring search; wildcards in the query are literal unless ``raw_like``."""
    if not raw_like:
        query = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{query}%"


def search(mentions: DataFrame, assertions: DataFrame, query: str, limit: int = 100, raw_like: bool = False) -> DataFrame:
    """Mentions and assertions that hold a text: part, id, text; each part in order of day and id, ``limit`` at most."""
    pattern = like_pattern(query, raw_like)
    m = mentions.filter(F.col("name").ilike(pattern) | F.col("context").ilike(pattern)).orderBy("day", "id").limit(limit)
    a = assertions.filter(F.col("statement").ilike(pattern)).orderBy("created_at", "id").limit(limit)
    return m.select(F.lit("mention").alias("part"), "id", F.col("name").alias("text")).unionByName(a.select(F.lit("assertion").alias("part"), "id", F.col("statement").alias("text")))


def conversations_for_name(mentions: DataFrame, assertions: DataFrame, name: str) -> DataFrame:
    """Conversations by how often they name something: conv_key, hits over both tables."""
    m = mentions.filter(F.lower("name") == name.lower()).groupBy("conv_key").agg(F.count("*").alias("hits"))
    a = assertions.filter(F.col("statement").ilike(like_pattern(name))).groupBy("conv_key").agg(F.count("*").alias("hits"))
    return m.unionByName(a).groupBy("conv_key").agg(F.sum("hits").alias("hits")).orderBy(F.col("hits").desc(), "conv_key")


def source_stats(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("source").agg(F.count("*").alias("n"), F.sum("message_count").alias("messages"), F.min("created_at").alias("first"), F.max("updated_at").alias("last"))


def monthly_density(conversations: DataFrame) -> DataFrame:
    rows = conversations.filter("created_at is not null")
    return rows.groupBy(F.substring("created_at", 1, 7).alias("month"), "source").agg(F.count("*").alias("n"))


def freshness(conversations: DataFrame) -> DataFrame:
    """Per source: conversations, messages, last update, and how many are excluded."""
    return conversations.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("message_count").alias("messages"), F.max("updated_at").alias("last"), F.count_if(~not_excluded(keep_null=True)).alias("excluded")
    )


def embedding_coverage(messages: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: embeddable messages, embedded ones, and the whole per cent of them."""
    rows = messages.filter("text <> ''").select("conv_key", "native_id").join(embedded.select("conv_key", "native_id").distinct().withColumn("has", F.lit(1)), ["conv_key", "native_id"], "left")
    out = rows.agg(F.count("*").alias("embeddable"), F.count("has").alias("embedded"))
    return out.withColumn("pct", F.expr("100 * embedded div greatest(embeddable, 1)"))


def embed_pending(messages: DataFrame, embedded: DataFrame, limit: int = 256) -> DataFrame:
    """Messages with text and no vector, in key order."""
    rows = messages.filter("text <> ''").join(embedded, ["conv_key", "native_id"], "left_anti")
    return rows.select("conv_key", "native_id").orderBy("conv_key", "native_id").limit(clamp(limit, 1024))


def accept_embeddings(batch: DataFrame, embedded: DataFrame, dim: int) -> DataFrame:
    """Rows of ``batch(seq, conv_key, native_id, embedding)`` of the right dimension that have no vector yet; the first of each key."""
    first = batch.filter(F.size("embedding") == dim).groupBy("conv_key", "native_id").agg(F.min_by("embedding", "seq").alias("embedding"))
    return first.join(embedded, ["conv_key", "native_id"], "left_anti")


def seed_jobs(conversations: DataFrame, jobs: DataFrame) -> DataFrame:
    """New pending jobs for conversations that are not excluded and have none."""
    return conversations.filter(not_excluded()).select("conv_key", "created_at").join(jobs, "conv_key", "left_anti").withColumn("status", F.lit("pending"))


def claimable(jobs: DataFrame, conversations: DataFrame, now: Column, stale_hours: int = 2) -> DataFrame:
    """Jobs in the order in which they are claimed: pending ones, and claims older than ``stale_hours``; oldest conversation first."""
    stale = (F.col("status") == "claimed") & (F.to_timestamp("claimed_at") < now - F.make_interval(hours=F.lit(stale_hours)))
    open_jobs = jobs.filter((F.col("status") == "pending") | stale)
    return open_jobs.join(conversations.select("conv_key", "created_at"), "conv_key").orderBy(F.col("created_at").asc_nulls_first(), "conv_key")


def claim(jobs: DataFrame, conversations: DataFrame, now: Column, worker: str, stale_hours: int = 2) -> DataFrame:
    """Jobs(conv_key, status, worker, claimed_at) after one claim: stale claims are pending again, and the first pending job, in
    the order of its conversation, is the worker's. No pending job: nothing is claimed."""
    stale = (F.col("status") == "claimed") & (F.to_timestamp("claimed_at") < now - F.make_interval(hours=F.lit(stale_hours)))
    head = claimable(jobs, conversations, now, stale_hours).select(F.col("conv_key").alias("_head")).limit(1)
    rows = jobs.join(F.broadcast(head), F.col("conv_key") == F.col("_head"), "left")
    mine = F.col("_head").isNotNull()
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.withColumns({
        "status": F.when(mine, "claimed").when(stale, "pending").otherwise(F.col("status")),
        "worker": F.when(mine, worker).when(~F.coalesce(stale, F.lit(False)), F.col("worker")),
        "claimed_at": F.when(mine, stamp).otherwise(F.col("claimed_at")),
    }).drop("_head")


def complete(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after workers reported: ``outcomes(conv_key, seq, failed, completed_at)``, the last report of a job counts."""
    last = outcomes.groupBy("conv_key").agg(F.max_by(F.struct("failed", "completed_at"), "seq").alias("_o"))
    rows = jobs.join(last, "conv_key", "left")
    done = F.when(F.coalesce("_o.failed", F.lit(False)), "failed").otherwise("done")
    return rows.withColumn("status", F.when(F.col("_o").isNotNull(), done).otherwise(F.col("status"))).withColumn("completed_at", F.col("_o.completed_at")).drop("_o")


def queue_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def ledger_totals(mentions: DataFrame, assertions: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row: mentions, assertions, chunks and invalid_chunks."""
    counts = mentions.agg(F.count("*").alias("mentions")).crossJoin(assertions.agg(F.count("*").alias("assertions")))
    return counts.crossJoin(extractions.agg(F.count("*").alias("chunks"), F.count_if(F.col("valid") == 0).alias("invalid_chunks")))


def submit_chunks(stored: DataFrame, submitted: DataFrame) -> DataFrame:
    """Extractions after a submission: a submitted (conv_key, chunk_idx) replaces the stored one, the last submission wins."""
    last = submitted.groupBy("conv_key", "chunk_idx").agg(F.max_by(F.struct("valid", "payload"), "seq").alias("p")).select("conv_key", "chunk_idx", "p.valid", "p.payload")
    return stored.join(last, ["conv_key", "chunk_idx"], "left_anti").select("conv_key", "chunk_idx", "valid", "payload").unionByName(last)


def progress(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("conv_key").agg((F.max("chunk_idx") + 1).alias("chunks_done"), F.count_if(F.col("valid") == 0).alias("invalid"))


def delete_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def purge(rows: DataFrame, column: str, name: str = "", conversations: DataFrame | None = None) -> DataFrame:
    """Rows that neither hold ``name`` in a column nor belong to the listed conversations."""
    if name:
        rows = rows.filter(~F.coalesce(F.col(column).ilike(like_pattern(name)), F.lit(False)))
    return rows.join(conversations.select("conv_key"), "conv_key", "left_anti") if conversations is not None else rows


def override_owners(conversations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Conversations with the last override of their owner, which outlives every re-ingest: overrides(conv_key, seq, owner)."""
    last = overrides.groupBy("conv_key").agg(F.max_by("owner", "seq").alias("_owner"))
    return conversations.join(last, "conv_key", "left").withColumn("owner", F.coalesce("_owner", "owner")).drop("_owner")


#: The vocabularies of extraction payloads.
MENTION_SPEAKERS, SPEAKERS = ("user", "assistant"), ("user", "assistant", "both")
ASSERTION_TYPES = ("decision", "advice", "problem", "solution", "fact", "preference", "lesson", "open_thread", "question")


def payload_problems(top_keys: Column, mentions: Column, assertions: Column) -> Column:
    """Problems of an extraction payload as an array of strings, in order; valid payloads have none."""
    missing = F.transform(F.filter(F.array(*map(F.lit, ("mentions", "assertions", "state"))), lambda k: ~F.array_contains(top_keys, k)), lambda k: F.concat(F.lit("missing "), k))
    types = F.transform(F.filter(assertions, lambda a: ~F.coalesce(a["type"].isin(*ASSERTION_TYPES), F.lit(False))), lambda a: F.concat(F.lit("assertion type "), F.coalesce(a["type"], F.lit("?"))))
    says = F.transform(F.filter(assertions, lambda a: ~F.coalesce(a["speaker"].isin(*SPEAKERS), F.lit(False))), lambda a: F.concat(F.lit("assertion speaker "), F.coalesce(a["speaker"], F.lit("?"))))
    who = F.transform(F.filter(mentions, lambda m: ~F.coalesce(m["speaker"].isin(*MENTION_SPEAKERS), F.lit(False))), lambda m: F.concat(F.lit("mention speaker "), F.coalesce(m["speaker"], F.lit("?"))))
    none = F.array().cast("array<string>")
    return F.concat(missing, F.coalesce(types, none), F.coalesce(says, none), F.coalesce(who, none))


def remap_evidence(ids: Column, known: Column) -> Column:
    """Local evidence ids as message ids; ids that ``known`` (a map) lacks are dropped."""
    return F.filter(F.transform(ids, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())
