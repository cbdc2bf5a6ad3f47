"""Statistics, browsing, worksheets and curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import ledger
from memloom.operators.substring_index import SubstringIndex
from memloom.operators.tables import new_path
from memloom.sources import views as v

AFTER, BEFORE = "2024-01-03", "2024-01-10"


def jobs(spark, sf):
    """Jobs of the first conversations: every third done, every fifth claimed (half of these stale), the rest pending."""
    n = F.substring_index("conv_key", ":", -1).cast("long")
    claimed = F.when(n % 5 == 1, F.when(n % 2 == 0, F.lit("2024-02-01T06:00:00+00:00")).otherwise(F.lit("2024-02-01T11:30:00+00:00")))
    status = F.when(n % 3 == 0, "done").when(n % 5 == 1, "claimed").otherwise("pending")
    return v.conversations(spark, sf).filter(n % 7 != 6).select("conv_key", status.alias("status"), claimed.alias("claimed_at"))


JOBS = """v_jobs AS (SELECT conv_key, CASE WHEN n % 3 = 0 THEN 'done' WHEN n % 5 = 1 THEN 'claimed' ELSE 'pending' END AS status,
  CASE WHEN n % 5 = 1 THEN CASE WHEN n % 2 = 0 THEN '2024-02-01T06:00:00+00:00' ELSE '2024-02-01T11:30:00+00:00' END END AS claimed_at
  FROM (SELECT conv_key, split_part(conv_key, ':', 2)::BIGINT AS n FROM v_conversations) WHERE n % 7 <> 6)"""


def embedded(spark, sf):
    """Messages that have a vector: those at even places."""
    return v.messages(spark, sf).filter("pos % 2 = 0").select("conv_key", "native_id")


def extractions(spark, sf):
    m = v.mentions(spark, sf)
    return m.groupBy("conv_key", "chunk_idx").agg(F.min(F.when(F.col("id") % 11 == 0, 0).otherwise(1)).alias("valid"), F.min("name").alias("payload"))


EXTRACTIONS = "v_ext AS (SELECT conv_key, chunk_idx, min(CASE WHEN id % 11 = 0 THEN 0 ELSE 1 END) AS valid, min(name) AS payload FROM v_mentions GROUP BY 1, 2)"


def submitted(spark, sf):
    m = v.mentions(spark, sf).filter("id % 4 = 0")
    return m.select("conv_key", (F.col("chunk_idx") + 0).alias("chunk_idx"), F.lit(1).alias("valid"), F.concat(F.lit("new "), "name").alias("payload"), F.col("id").alias("seq"))


def payloads(spark, sf):
    """Extraction payloads of every chunk, some of them broken."""
    a = v.assertions(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, (*ledger.ASSERTION_TYPES, "rumour"))), (F.col("id") % 10 + 1).cast("int"))
    speaker = F.when(F.col("id") % 17 == 0, "nobody").otherwise(F.col("speaker"))
    rows = a.groupBy("conv_key", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("id", kind.alias("type"), speaker.alias("speaker")))).alias("assertions"), F.min("id").alias("first"))
    top = F.when(F.col("first") % 13 == 0, F.array(F.lit("mentions"), F.lit("assertions"))).otherwise(F.array(F.lit("mentions"), F.lit("assertions"), F.lit("state")))
    return rows.select("conv_key", "chunk_idx", top.alias("top"), "assertions")


def payload_validation(spark, sf):
    who = F.when(F.col("id") % 19 == 0, "both").otherwise(F.when(F.col("id") % 2 == 0, "user").otherwise("assistant"))
    said = v.mentions(spark, sf).groupBy("conv_key", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("id", who.alias("speaker")))).alias("mentions"))
    rows = payloads(spark, sf).join(said, ["conv_key", "chunk_idx"])
    rows = rows.withColumn("problems", ledger.payload_problems(F.col("top"), F.col("mentions"), F.col("assertions")))
    return rows.select("conv_key", "chunk_idx", F.array_join("problems", "; ").alias("problems"), (F.size("problems") == 0).alias("valid"))


def evidence_remap(spark, sf):
    rows = v.messages(spark, sf).groupBy("conv_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("x"), "pos").alias("k"), "native_id")))).alias("known"))
    ids = F.array(F.lit("x1"), F.lit("x99"), F.lit("x0"), F.lit("x3"))
    return rows.select("conv_key", F.array_join(ledger.remap_evidence(ids, F.col("known")), ",").alias("evidence"))


def worked(spark, sf):
    return jobs(spark, sf).withColumn("worker", F.when(F.col("status") == "claimed", "w0"))


def claimed(spark, sf):
    at = F.to_timestamp(F.lit("2024-02-01T12:00:00+00:00"))
    return ledger.claim(worked(spark, sf), v.conversations(spark, sf), at, "w1").select("conv_key", "status", "worker")


def completed(spark, sf):
    """Reports on claimed jobs: some twice, of which the last says that they failed."""
    open_jobs = jobs(spark, sf).filter("status = 'claimed'")
    n = F.substring_index("conv_key", ":", -1).cast("long")
    first = open_jobs.select("conv_key", F.lit(1).alias("seq"), F.lit(False).alias("failed"), F.lit("t1").alias("completed_at"))
    again = open_jobs.filter(n % 4 == 0).select("conv_key", F.lit(2).alias("seq"), F.lit(True).alias("failed"), F.lit("t2").alias("completed_at"))
    return ledger.complete(jobs(spark, sf), first.unionByName(again)).select("conv_key", "status", "completed_at")


def accepted(spark, sf):
    """Vectors offered for messages, some of a wrong size, some twice: the first of each counts, where there is none."""
    m = v.messages(spark, sf)
    size = F.when(F.col("pos") % 4 == 1, 2).otherwise(3)
    one = m.select(F.lit(1).alias("seq"), "conv_key", "native_id", F.array_repeat(F.col("pos").cast("double"), size).alias("embedding"))
    two = m.select(F.lit(2).alias("seq"), "conv_key", "native_id", F.array_repeat(F.lit(-1.0), 3).alias("embedding"))
    rows = ledger.accept_embeddings(one.unionByName(two), embedded(spark, sf).filter("native_id <> 'm2'"), 3)
    return rows.select("conv_key", "native_id", F.element_at("embedding", 1).alias("x"))


def worksheet(spark, sf):
    return ledger.mention_worksheet(v.mentions(spark, sf), v.threads(spark, sf))


def overrides(spark, sf):
    n = F.col("conv_id")
    rows = v.table(spark, sf, "conversations").filter((n % 4 == 0) & (F.col("turn") <= 1))
    key = F.concat(F.lit("claude.ai:"), n)
    return rows.select(key.alias("conv_key"), F.col("turn").alias("seq"), F.concat(F.lit("owner"), F.col("turn")).alias("owner"))


def substrings(spark, sf):
    """Statements found by what they contain, in an index in which a third came again in other words and a tenth went."""
    rows = v.assertions(spark, sf).select(F.col("id").cast("string").alias("key"), F.col("statement").alias("text"), "id")
    index = SubstringIndex(spark, new_path(spark, "substrings"))
    index.add(0, rows.drop("id"))
    again = rows.filter("id % 3 = 0 or id % 10 = 3").withColumn("text", F.when(F.col("id") % 10 != 3, F.concat(F.lit("New: "), "text")))
    index.add(1, again.drop("id"))
    found = [index.search(p).withColumn("pattern", F.lit(p)) for p in ("%W: K42 %", "%k1_ %_ck%", "%4", "%none of these%")]
    return reduce(DataFrame.unionByName, found)


QUERIES = {
    "source_stats": lambda s, d: ledger.source_stats(v.conversations(s, d)),
    "monthly_density": lambda s, d: ledger.monthly_density(v.conversations(s, d)),
    "freshness_status": lambda s, d: ledger.freshness(v.conversations(s, d)),
    "embedding_coverage": lambda s, d: ledger.embedding_coverage(v.messages(s, d), embedded(s, d)),
    "embed_pending": lambda s, d: ledger.embed_pending(v.messages(s, d), embedded(s, d)),
    "queue_status": lambda s, d: ledger.queue_status(jobs(s, d)),
    "ledger_totals": lambda s, d: ledger.ledger_totals(v.mentions(s, d), v.assertions(s, d), extractions(s, d)),
    "job_claim": claimed,
    "job_complete": completed,
    "embed_accept": accepted,
    "queue_claimable": lambda s, d: ledger.claimable(jobs(s, d), v.conversations(s, d), F.to_timestamp(F.lit("2024-02-01T12:00:00+00:00"))).select("conv_key", "status", "created_at"),
    "seed_jobs": lambda s, d: ledger.seed_jobs(v.conversations(s, d), jobs(s, d)),
    "chunk_submit": lambda s, d: ledger.submit_chunks(extractions(s, d), submitted(s, d)),
    "chunk_progress": lambda s, d: ledger.progress(extractions(s, d)),
    "browse_conversations": lambda s, d: ledger.browse(v.conversations(s, d), AFTER, BEFORE, "claude.ai", 100),
    "paged_listing": lambda s, d: ledger.browse(v.conversations(s, d), limit=50, offset=20, most=200),
    "mention_worksheet": worksheet,
    "mentions_by_name": lambda s, d: ledger.by_name(v.mentions(s, d), "K7").select("id", "conv_key", "name", "kind"),
    "conversations_for_name": lambda s, d: ledger.conversations_for_name(v.mentions(s, d), v.assertions(s, d), "k7"),
    "substring_search": substrings,
    "ledger_search": lambda s, d: ledger.search(v.mentions(s, d), v.assertions(s, d), "K42 "),
    "curate_delete": lambda s, d: ledger.delete_ids(v.mentions(s, d), v.mentions(s, d).filter("id % 3 = 0")).select("id", "name"),
    "curate_purge": lambda s, d: ledger.purge(v.mentions(s, d), "name", "k1", v.mentions(s, d).filter("id % 97 = 0")).select("id", "name"),
    "owner_overrides": lambda s, d: ledger.override_owners(v.conversations(s, d), overrides(s, d)).select("conv_key", "owner"),
    "payload_validation": payload_validation,
    "evidence_remap": evidence_remap,
}

_c = v.with_views("messages", "conversations")
_m = v.with_views("mentions")
_mt = v.with_views("mentions", "threads")
_ma = v.with_views("mentions", "assertions")
ORACLES = {
    "source_stats": f"{_c} SELECT source, count(*) AS n, sum(message_count)::BIGINT AS messages, min(created_at) AS first, max(updated_at) AS last FROM v_conversations GROUP BY source",
    "monthly_density": f"{_c} SELECT substr(created_at, 1, 7) AS month, source, count(*) AS n FROM v_conversations WHERE created_at IS NOT NULL GROUP BY ALL",
    "freshness_status": f"{_c} SELECT source, count(*) AS n, sum(message_count)::BIGINT AS messages, max(updated_at) AS last, count(*) FILTER (coalesce(owner, '') = 'sealed') AS excluded FROM v_conversations GROUP BY source",
    "embedding_coverage": f"{_c} SELECT count(*) AS embeddable, count(*) FILTER (pos % 2 = 0) AS embedded, (100 * count(*) FILTER (pos % 2 = 0) // greatest(count(*), 1))::BIGINT AS pct FROM v_messages WHERE text <> ''",
    "embed_pending": f"{_c} SELECT conv_key, native_id FROM v_messages WHERE text <> '' AND pos % 2 <> 0 ORDER BY 1, 2 LIMIT 256",
    "queue_status": f"{_c}, {JOBS} SELECT status, count(*) AS n FROM v_jobs GROUP BY status",
    "queue_claimable": f"{_c}, {JOBS} SELECT conv_key, status, created_at FROM v_jobs JOIN v_conversations USING (conv_key) WHERE status = 'pending' OR (status = 'claimed' AND claimed_at < '2024-02-01T10:00:00')",
    "seed_jobs": f"{_c}, {JOBS} SELECT conv_key, created_at, 'pending' AS status FROM v_conversations WHERE owner NOT IN ('sealed') AND conv_key NOT IN (SELECT conv_key FROM v_jobs)",
    "chunk_submit": f"{_m}, {EXTRACTIONS}, s AS (SELECT conv_key, chunk_idx, 1 AS valid, 'new ' || max_by(name, id) AS payload FROM v_mentions WHERE id % 4 = 0 GROUP BY 1, 2) SELECT * FROM s UNION ALL SELECT * FROM v_ext WHERE (conv_key, chunk_idx) NOT IN (SELECT conv_key, chunk_idx FROM s)",
    "chunk_progress": f"{_m}, {EXTRACTIONS} SELECT conv_key, max(chunk_idx) + 1 AS chunks_done, count(*) FILTER (valid = 0) AS invalid FROM v_ext GROUP BY 1",
    "browse_conversations": f"{_c} SELECT * FROM v_conversations WHERE owner NOT IN ('sealed') AND source = 'claude.ai' AND updated_at >= '{AFTER}T00:00:00' AND created_at <= '{BEFORE}T23:59:59.999999' ORDER BY updated_at DESC NULLS LAST, conv_key LIMIT 100",
    "paged_listing": f"{_c} SELECT * FROM v_conversations WHERE owner NOT IN ('sealed') ORDER BY updated_at DESC NULLS LAST, conv_key LIMIT 50 OFFSET 20",
    "ledger_totals": f"{_ma}, {EXTRACTIONS} SELECT (SELECT count(*) FROM v_mentions) AS mentions, (SELECT count(*) FROM v_assertions) AS assertions, count(*) AS chunks, count(*) FILTER (valid = 0) AS invalid_chunks FROM v_ext",
    "job_claim": f"""{_c}, {JOBS}, o AS (SELECT *, status = 'claimed' AND claimed_at < '2024-02-01T10:00:00' AS stale FROM v_jobs),
h AS (SELECT conv_key AS head FROM o JOIN v_conversations c USING (conv_key) WHERE status = 'pending' OR stale ORDER BY c.created_at NULLS FIRST, conv_key LIMIT 1)
SELECT conv_key, CASE WHEN conv_key = head THEN 'claimed' WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN conv_key = head THEN 'w1' WHEN status = 'claimed' AND NOT stale THEN 'w0' END AS worker FROM o, h""",
    "job_complete": f"{_c}, {JOBS} SELECT conv_key, CASE WHEN status <> 'claimed' THEN status WHEN split_part(conv_key, ':', 2)::BIGINT % 4 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN status = 'claimed' THEN CASE WHEN split_part(conv_key, ':', 2)::BIGINT % 4 = 0 THEN 't2' ELSE 't1' END END AS completed_at FROM v_jobs",
    "embed_accept": f"{_c} SELECT conv_key, native_id, CASE WHEN pos % 4 = 1 THEN -1.0::DOUBLE ELSE pos::DOUBLE END AS x FROM v_messages WHERE pos % 2 <> 0 OR native_id = 'm2'",
    "mention_worksheet": f"{_mt} SELECT name, count(*) AS n, count(DISTINCT conv_key) AS n_conversations, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM v_mentions JOIN (SELECT conv_key FROM v_threads WHERE owner NOT IN ('sealed')) USING (conv_key) GROUP BY name ORDER BY n DESC, name LIMIT 200",
    "mentions_by_name": f"{_m} SELECT id, conv_key, name, kind FROM v_mentions WHERE lower(name) = 'k7'",
    "conversations_for_name": f"{_ma} SELECT conv_key, sum(h)::BIGINT AS hits FROM (SELECT conv_key, count(*) AS h FROM v_mentions WHERE name = 'k7' GROUP BY 1 UNION ALL SELECT conv_key, count(*) FROM v_assertions WHERE statement ILIKE '%k7%' GROUP BY 1) GROUP BY 1",
    "substring_search": f"""{_ma} SELECT x.id::VARCHAR AS key, x.text, p.pattern FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'New: ' || statement ELSE statement END AS text FROM v_assertions WHERE id % 10 <> 3) x,
(SELECT unnest(['%W: K42 %', '%k1_ %_ck%', '%4', '%none of these%']) AS pattern) p WHERE x.text ILIKE p.pattern""",
    "ledger_search": f"{_ma} (SELECT 'mention' AS part, id, name AS text FROM v_mentions WHERE name ILIKE '%k42 %' OR context ILIKE '%k42 %' ORDER BY day, id LIMIT 100) UNION ALL (SELECT 'assertion', id, statement FROM v_assertions WHERE statement ILIKE '%k42 %' ORDER BY created_at, id LIMIT 100)",
    "curate_delete": f"{_m} SELECT id, name FROM v_mentions WHERE id % 3 <> 0",
    "curate_purge": f"{_m} SELECT id, name FROM v_mentions WHERE name NOT ILIKE '%k1%' AND conv_key NOT IN (SELECT conv_key FROM v_mentions WHERE id % 97 = 0)",
    "owner_overrides": f"{_c} SELECT c.conv_key, coalesce(o.owner, c.owner) AS owner FROM v_conversations c LEFT JOIN (SELECT 'claude.ai:' || conv_id AS conv_key, 'owner' || max(turn) AS owner FROM conversations WHERE conv_id % 4 = 0 AND turn <= 1 GROUP BY conv_id) o USING (conv_key)",
    "payload_validation": f"""{_ma}, p AS (SELECT conv_key, chunk_idx, min(id) AS first, list(struct_pack(id := id,
  t := CASE id % 10 WHEN 0 THEN 'decision' WHEN 1 THEN 'advice' WHEN 2 THEN 'problem' WHEN 3 THEN 'solution' WHEN 4 THEN 'fact' WHEN 5 THEN 'preference' WHEN 6 THEN 'lesson' WHEN 7 THEN 'open_thread' WHEN 8 THEN 'question' ELSE 'rumour' END,
  s := CASE WHEN id % 17 = 0 THEN 'nobody' ELSE speaker END) ORDER BY id) AS a FROM v_assertions GROUP BY 1, 2),
m AS (SELECT conv_key, chunk_idx, count(*) FILTER (id % 19 = 0) AS wrong FROM v_mentions GROUP BY 1, 2),
q AS (SELECT conv_key, chunk_idx, list_concat(list_concat(CASE WHEN first % 13 = 0 THEN ['missing state'] ELSE [] END,
  list_concat([('assertion type ' || x.t) FOR x IN a IF x.t = 'rumour'], [('assertion speaker ' || x.s) FOR x IN a IF x.s = 'nobody'])), [('mention speaker both') FOR i IN range(wrong)]) AS problems FROM p JOIN m USING (conv_key, chunk_idx))
SELECT conv_key, chunk_idx, coalesce(array_to_string(problems, '; '), '') AS problems, len(problems) = 0 AS valid FROM q""",
    "evidence_remap": f"{_c} SELECT conv_key, coalesce(string_agg(native_id, ',' ORDER BY CASE pos WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) FILTER (pos IN (0, 1, 3)), '') AS evidence FROM v_messages GROUP BY 1",
}
