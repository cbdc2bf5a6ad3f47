"""Ingest, active paths, hashes, redaction and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.operators import ledger, search, store
from memloom.operators.tables import new_path
from memloom.sources import views as v


def versions(spark, sf):
    """Conversation versions out of order: the events of a user as versions of one conversation, some without a timestamp."""
    e = v.table(spark, sf, "events")
    updated = F.when(F.col("event_id") % 29 == 0, F.lit(None)).otherwise(F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH"))
    return e.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("seq"), updated.alias("updated_at"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.col("event_type").alias("title"), (F.col("event_id") % 53 == 0).alias("forced"))


VERSIONS = """b AS (SELECT 'u' || user_id AS key, event_id AS seq, CASE WHEN event_id % 29 <> 0 THEN strftime(ts, '%Y-%m-%dT%H') END AS updated_at,
  strftime(ts, '%Y-%m-%d') AS created_at, event_type AS title, event_id % 53 = 0 AS forced FROM events)"""


def marked(spark, sf):
    m = v.messages(spark, sf)
    return store.mark_active(m, m.filter("is_leaf").select("conv_key", F.col("native_id").alias("leaf")))


ACTIVE = """walk AS (SELECT conv_key, native_id, parent_native_id FROM v_messages WHERE is_leaf
  UNION ALL SELECT m.conv_key, m.native_id, m.parent_native_id FROM walk w JOIN v_messages m ON m.conv_key = w.conv_key AND m.native_id = w.parent_native_id),
v_marked AS (SELECT m.*, w.native_id IS NOT NULL AS on_active_path FROM v_messages m LEFT JOIN walk w USING (conv_key, native_id))"""


def children(spark, sf):
    """Messages of which every third comes twice, the second time with other text."""
    m = v.messages(spark, sf).select("conv_key", "native_id", "pos", "text")
    again = m.filter("pos % 3 = 0").withColumn("text", F.concat(F.lit("again "), F.substring("text", 1, 20))).withColumn("pos", F.col("pos") + 1000)
    return store.last_children(m.unionByName(again))[0]


def paths(spark, sf):
    return marked(spark, sf).filter("on_active_path")


def window(spark, sf):
    m = marked(spark, sf)
    hits = m.filter("pos = 1").select("conv_key", "native_id")
    return search.context_window(m.filter("on_active_path").select("conv_key", "native_id", "pos"), hits, 1).select("conv_key", "native_id", "hit", "rn")


def budget(spark, sf):
    rows = paths(spark, sf).filter(F.coalesce("owner", F.lit("")) != "sealed").select("conv_key", "native_id", "pos", "text")
    return search.within_budget(rows, 600, 300).select("conv_key", "native_id", "used")


def parts(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.col("text"))
    return search.parts(d, 8000).select("doc_id", "part", "n_parts", F.md5("text").alias("digest"))


def chunked(spark, sf):
    rows = search.chunks(paths(spark, sf).select("conv_key", "native_id", "pos", "created_at", "text"), 3, 120)
    return rows.select("conv_key", "native_id", "chunk_idx", "local_id", "chunk_date", F.md5("text").alias("digest"))


def redacted(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    return d.filter(t.has_secret(F.col("text"))).select("doc_id", F.md5(t.redact(F.col("text"))).alias("digest"))


def known(spark, sf):
    """A list of known secrets as a file holds it, masked before the patterns."""
    listed = t.known_secrets("# comment that is long\nof the house\nshort\nand the dog")
    d = v.table(spark, sf, "documents").select("doc_id", "text").filter(t.has_secret(F.col("text"), listed))
    return d.select("doc_id", F.md5(t.redact(F.col("text"), listed)).alias("digest"))


def redaction_totals(spark, sf):
    d = v.table(spark, sf, "documents").select("text")
    counts = d.filter(t.has_secret(F.col("text"))).select(F.explode(t.redaction_counts(F.col("text"))).alias("name", "n"))
    return counts.groupBy("name").agg(F.sum("n").cast("long").alias("n"))


def archived(spark, sf):
    """Every version in the archive, by source and month of ingest, whether or not it survives."""
    rows = versions(spark, sf).withColumn("source", F.col("title")).withColumn("ingest_month", F.substring("created_at", 1, 7))
    path = new_path(spark, "archive")
    for k in range(2):
        store.write_archive(rows.filter(F.col("seq") % 2 == k), path)
    return spark.read.json(path).groupBy("source", "ingest_month").agg(F.count("*").alias("n"))


QUERIES = {
    "newest_wins_upsert": lambda s, d: store.newest_wins(versions(s, d), force="forced").select("key", "seq", "updated_at", "created_at", "title"),
    "archive_versions": archived,
    "record_lookup": lambda s, d: v.conversations(s, d).filter((F.col("conv_key") == "chatgpt.com:1") & ledger.not_excluded(keep_null=True)),
    "child_last_wins": lambda s, d: children(s, d).select("conv_key", "native_id", "pos", F.md5("text").alias("digest")),
    "active_path": lambda s, d: marked(s, d).select("conv_key", "native_id", "on_active_path"),
    "branch_stats": lambda s, d: store.branch_stats(marked(s, d)),
    "content_hashes": lambda s, d: v.messages(s, d).select("conv_key", "native_id", t.content_hash(F.col("role"), F.col("text")).alias("content_hash")),
    "hash_dedup": lambda s, d: v.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")),
    "redact_secrets": redacted,
    "redaction_counts": redaction_totals,
    "redact_known": known,
    "conversation_window": window,
    "budget_window": budget,
    "message_parts": parts,
    "chunk_messages": chunked,
}

_msg = v.with_views("messages")


def _masked(text: str) -> str:
    for name, pattern in t.SECRETS:
        text = f"regexp_replace({text}, '{pattern}', '\\1[REDACTED:{name}]', 'g')"
    return text


ORACLES = {
    "archive_versions": f"WITH {VERSIONS} SELECT title AS source, substr(created_at, 1, 7) AS ingest_month, count(*) AS n FROM b GROUP BY ALL",
    "record_lookup": f"{v.with_views('messages', 'conversations')} SELECT * FROM v_conversations WHERE conv_key = 'chatgpt.com:1' AND coalesce(owner, '') NOT IN ('sealed')",
    "newest_wins_upsert": f"""WITH {VERSIONS}, r AS (SELECT key, max(seq) FILTER (updated_at IS NULL OR forced) AS reset, min_by(created_at, seq) AS created FROM b GROUP BY key),
x AS (SELECT b.*, created, row_number() OVER (PARTITION BY b.key ORDER BY updated_at DESC NULLS LAST, seq) AS rn FROM b JOIN r ON b.key = r.key WHERE reset IS NULL OR seq >= reset)
SELECT key, seq, updated_at, created AS created_at, title FROM x WHERE rn = 1""",
    "child_last_wins": f"{_msg} SELECT conv_key, native_id, CASE WHEN pos % 3 = 0 THEN pos + 1000 ELSE pos END AS pos, md5(CASE WHEN pos % 3 = 0 THEN 'again ' || substr(text, 1, 20) ELSE text END) AS digest FROM v_messages",
    "active_path": f"{_msg}, {ACTIVE} SELECT conv_key, native_id, on_active_path FROM v_marked",
    "branch_stats": f"{_msg}, {ACTIVE}, k AS (SELECT conv_key, parent_native_id, count(*) AS n FROM v_messages WHERE parent_native_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT conv_key, count(*) AS message_count, count(*) FILTER (NOT on_active_path) AS abandoned, coalesce((SELECT count(*) FROM k WHERE k.conv_key = v_marked.conv_key), 0) AS branch_points FROM v_marked GROUP BY conv_key",
    "content_hashes": f"{_msg} SELECT conv_key, native_id, substr(sha256(role || chr(0) || text), 1, 16) AS content_hash FROM v_messages",
    "hash_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "redact_secrets": f"SELECT doc_id, md5({_masked('text')}) AS digest FROM documents WHERE {_masked('text')} <> text",
    "redact_known": f"WITH d AS (SELECT doc_id, text, replace(replace(text, 'of the house', '[REDACTED:known-credential]'), 'and the dog', '[REDACTED:known-credential]') AS k FROM documents) SELECT doc_id, md5({_masked('k')}) AS digest FROM d WHERE {_masked('k')} <> text",
    "redaction_counts": f"WITH d AS (SELECT {_masked('text')} AS masked FROM documents), n AS (SELECT unnest(regexp_extract_all(masked, '\\[REDACTED:([a-z-]+)\\]', 1)) AS name FROM d) SELECT name, count(*) AS n FROM n GROUP BY name",
    "conversation_window": f"""{_msg}, {ACTIVE}, p AS (SELECT conv_key, native_id, row_number() OVER (PARTITION BY conv_key ORDER BY pos) AS rn FROM v_marked WHERE on_active_path),
h AS (SELECT m.conv_key, m.native_id AS hit, p.rn AS hr FROM v_messages m LEFT JOIN p USING (conv_key, native_id) WHERE pos = 1)
SELECT conv_key, p.native_id, hit, rn FROM p JOIN h USING (conv_key) WHERE hr IS NULL OR abs(rn - hr) <= 1""",
    "budget_window": f"""{_msg}, {ACTIVE}, p AS (SELECT conv_key, native_id, row_number() OVER w AS rn, sum(length(substr(text, 1, 300))) OVER w AS used FROM v_marked
WHERE on_active_path AND coalesce(owner, '') <> 'sealed' WINDOW w AS (PARTITION BY conv_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_key, native_id, used::BIGINT AS used FROM p WHERE used <= 600 OR rn = 1""",
    "message_parts": "WITH d AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 8000.0))::INTEGER AS n_parts FROM documents), e AS (SELECT *, unnest(range(1, n_parts + 1))::INTEGER AS part FROM d) SELECT doc_id, part, n_parts, md5(substr(text, (part - 1) * 8000 + 1, 8000)) AS digest FROM e",
    "chunk_messages": f"""{_msg}, {ACTIVE}, p AS (SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY pos) AS rn FROM v_marked WHERE on_active_path AND trim(text) <> '')
SELECT conv_key, native_id, ((rn - 1) // 3)::INTEGER AS chunk_idx, 'm' || rn AS local_id, substr(first(created_at) OVER (PARTITION BY conv_key, (rn - 1) // 3 ORDER BY pos), 1, 10) AS chunk_date,
md5(CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || ' [...truncated]' ELSE text END) AS digest FROM p""",
}
