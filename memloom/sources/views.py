"""The engine's tables, projected from the shared Parquet tables.

Every view is a function of (spark, sf_dir); the SQL of the same view, for checks in another engine, stands next to it
in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOURCES = ("claude.ai", "chatgpt.com", "coding-session", "gemini.google.com")
TYPES = ("person", "org", "project", "topic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _iso(hours: Column, minutes: Column) -> Column:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"), mins=minutes.cast("int"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_key, source, native_id, parent_native_id, pos, role, created_at, text, owner; the last turn of each fifth conversation is a branch."""
    rows = table(spark, sf_dir, "conversations")
    rows = rows.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    back = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == F.col("last")) & (F.col("turn") >= 2), 2).otherwise(1)
    source = _pick(SOURCES, F.col("conv_id"))
    owner = F.when(F.col("conv_id") % 10 == 0, "sealed").when(F.col("conv_id") % 10 != 1, "unknown")
    return rows.select(
        F.concat(source, F.lit(":"), F.col("conv_id")).alias("conv_key"),
        source.alias("source"),
        F.concat(F.lit("m"), F.col("turn")).alias("native_id"),
        F.when(F.col("turn") >= back, F.concat(F.lit("m"), F.col("turn") - back)).alias("parent_native_id"),
        F.col("turn").alias("pos"),
        "role",
        _iso(F.col("conv_id"), F.col("turn")).alias("created_at"),
        "text",
        owner.alias("owner"),
        (F.col("turn") == F.col("last")).alias("is_leaf"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation: conv_key, source, title, owner, created_at, updated_at, message_count."""
    return (
        messages(spark, sf_dir)
        .groupBy("conv_key", "source")
        .agg(
            F.substring(F.min_by("text", "pos"), 1, 30).alias("title"),
            F.min("owner").alias("owner"),
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("updated_at"),
            F.count("*").alias("message_count"),
        )
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_key, chunk_idx, name, kind, context, day, entity_id of every mention."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("conv_key"),
        F.dayofmonth("ts").alias("chunk_idx"),
        F.concat(F.lit("k"), k).alias("name"),
        F.col("event_type").alias("kind"),
        F.concat_ws(" ", F.lit("seen with"), "event_type", F.col("user_id").cast("string")).alias("context"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        k.cast("long").alias("entity_id"),
    )


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_key, chunk_idx, type, statement, rationale, speaker, evidence, created_at of every assertion."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("conv_key"),
        F.dayofmonth("ts").alias("chunk_idx"),
        F.col("event_type").alias("type"),
        F.concat_ws(" ", F.concat(F.lit("k"), k), "event_type", (F.col("event_id") % 7).cast("string")).alias("statement"),
        F.when(F.col("event_id") % 11 == 0, "her Sister said so").when(F.col("event_id") % 5 == 0, F.concat(F.lit("after Alias "), (F.col("event_id") % 100).cast("string"))).alias("rationale"),
        _pick(("user", "assistant", "both"), F.col("event_id")).alias("speaker"),
        F.when(F.col("event_id") % 13 != 0, F.array(F.concat(F.lit("e"), "event_id"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation of mentions and assertions: conv_key, owner, created_at."""
    owner = F.when(F.col("user_id") % 10 == 0, "sealed").when(F.col("user_id") % 10 != 1, "unknown")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return rows.select(F.concat(F.lit("u"), "user_id").alias("conv_key"), owner.alias("owner"), "created_at")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, canonical, type, mentions of every entity."""
    found = mentions(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return found.select("entity_id", F.concat(F.lit("k"), F.col("entity_id")).alias("canonical"), _pick(TYPES, F.col("entity_id")).alias("type"), "mentions")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, entity_id): each entity's name, a short name that ten entities share, and an upper-case form."""
    e = entities(spark, sf_dir)
    forms = F.array("canonical", F.concat(F.lit("g"), (F.col("entity_id") % 10).cast("string")), F.concat(F.lit("Alias "), F.col("entity_id").cast("string")))
    return e.select(F.explode(forms).alias("alias"), "entity_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_key, native_id, label, embedding; owner and source as for conversations."""
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", _pick(SOURCES, F.col("vec_id")).alias("source"), F.when(F.col("vec_id") % 10 == 0, "sealed").otherwise("unknown").alias("owner"), "label", "embedding")


_SOURCE = "CASE {0} % 4 WHEN 0 THEN 'claude.ai' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'coding-session' ELSE 'gemini.google.com' END"

#: SQL of the views, in order of dependence.
CTE = {
    "messages": f"""c0 AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
c1 AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND turn = last AND turn >= 2 THEN 2 ELSE 1 END AS back, {_SOURCE.format('conv_id')} AS source FROM c0),
v_messages AS (SELECT source || ':' || conv_id AS conv_key, source, 'm' || turn AS native_id,
  CASE WHEN turn >= back THEN 'm' || (turn - back) END AS parent_native_id, turn AS pos, role,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at,
  text, CASE WHEN conv_id % 10 = 0 THEN 'sealed' WHEN conv_id % 10 <> 1 THEN 'unknown' END AS owner, turn = last AS is_leaf FROM c1)""",
    "conversations": """v_conversations AS (SELECT conv_key, source, substr(min_by(text, pos), 1, 30) AS title, min(owner) AS owner,
  min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS message_count FROM v_messages GROUP BY conv_key, source)""",
    "mentions": """v_mentions AS (SELECT event_id AS id, 'u' || user_id AS conv_key, day(ts)::INTEGER AS chunk_idx,
  'k' || regexp_extract(props, '"k": *([0-9]+)', 1) AS name, event_type AS kind, 'seen with ' || event_type || ' ' || user_id AS context,
  strftime(ts, '%Y-%m-%d') AS day, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS entity_id FROM events)""",
    "assertions": """v_assertions AS (SELECT event_id AS id, 'u' || user_id AS conv_key, day(ts)::INTEGER AS chunk_idx, event_type AS type,
  'k' || regexp_extract(props, '"k": *([0-9]+)', 1) || ' ' || event_type || ' ' || (event_id % 7) AS statement,
  CASE WHEN event_id % 11 = 0 THEN 'her Sister said so' WHEN event_id % 5 = 0 THEN 'after Alias ' || (event_id % 100) END AS rationale,
  CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'both' END AS speaker,
  CASE WHEN event_id % 13 <> 0 THEN ['e' || event_id] ELSE [] END AS evidence,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events)""",
    "threads": """v_threads AS (SELECT 'u' || user_id AS conv_key, CASE WHEN user_id % 10 = 0 THEN 'sealed' WHEN user_id % 10 <> 1 THEN 'unknown' END AS owner,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS created_at FROM events GROUP BY user_id)""",
    "entities": """v_entities AS (SELECT entity_id, 'k' || entity_id AS canonical,
  CASE entity_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'project' ELSE 'topic' END AS type, count(*) AS mentions
  FROM v_mentions GROUP BY entity_id)""",
    "aliases": """v_aliases AS (SELECT unnest([canonical, 'g' || (entity_id % 10), 'Alias ' || entity_id]) AS alias, entity_id FROM v_entities)""",
    "vectors": f"""v_vectors AS (SELECT vec_id, {_SOURCE.format('vec_id')} AS source,
  CASE WHEN vec_id % 10 = 0 THEN 'sealed' ELSE 'unknown' END AS owner, label, embedding FROM embeddings)""",
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views, for SQL checks."""
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in names)
