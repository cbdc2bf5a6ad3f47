"""Incremental sync, delivery and progress: the connector side, without the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from memloom.sources import gemini, records

#: Reader of each provider's raw texts (column value).
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claude.ai": records.claude_records,
    "chatgpt.com": records.chatgpt_records,
    "gemini.google.com": lambda raw: gemini.decode_turns(gemini.decode(raw)),
}


def changed_since(listing: DataFrame, cursor: str, limit: int = 25) -> DataFrame:
    """Conversations of a provider's listing that changed after the cursor, the oldest first, and all that share the last one's time.

    A page of ``limit`` rows in rising order, so that its greatest time is a cursor behind which nothing is lost, however
    many conversations changed; ``next_cursor`` gives it.
    """
    changed = listing.filter(F.col("updated_at") > cursor)
    last = changed.orderBy("updated_at").limit(limit).agg(F.max("updated_at").alias("_last"))
    return changed.join(F.broadcast(last), F.col("updated_at") <= F.col("_last")).drop("_last").orderBy("updated_at", "key")


def next_cursor(page: DataFrame, cursor: str) -> DataFrame:
    """One row: the cursor after a page, the old one for an empty page."""
    return page.agg(F.greatest(F.max("updated_at"), F.lit(cursor)).alias("cursor"))


def pending(queue: DataFrame, limit: int = 20) -> DataFrame:
    """Undelivered records in order, as many as one cycle sends."""
    return queue.filter("shipped = 0").orderBy("updated_at", "key").limit(limit)


def delivered(queue: DataFrame, outcome: DataFrame) -> DataFrame:
    """The queue after a cycle: outcome(key, seq, ok); a cycle stops at its first failure, so only what came before it is marked."""
    first_failure = outcome.filter(~F.col("ok")).agg(F.min("seq").alias("stop"))
    sent = outcome.crossJoin(F.broadcast(first_failure)).filter("ok and (stop is null or seq < stop)").select("key", F.lit(1).alias("_sent"))
    return queue.join(sent, "key", "left").withColumn("shipped", F.greatest("shipped", F.coalesce("_sent", F.lit(0)))).drop("_sent")


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def observed(rows: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """Rows that report their number and ``metrics`` (aggregate columns) when an action runs over them."""
    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), watch
