"""Bronze to silver: newest-wins conversations, their messages, active paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.tables import Scratch, stored


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def newest_wins(bronze: DataFrame, key: str = "key", seq: str = "seq", updated: str = "updated_at", created: str = "created_at", force: str | None = None, join: str | None = None) -> DataFrame:
    """The surviving version of each key after its versions arrived in order of ``seq``; the first created_at stays.

    A version without a timestamp, or a forced one, replaces whatever is there, and anything replaces a version
    without a timestamp; otherwise only a later timestamp does, so the first arrival wins ties. In closed form: only
    versions from the last reset on compete. Both steps are aggregates, so a key with many versions needs no window.
    ``join`` names a join hint for keys of few versions, so that none of it is broadcast.
    """
    reset = blank(F.col(updated)) | (F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False))
    last = bronze.groupBy(key).agg(F.max(F.when(reset, F.col(seq))).alias("_reset"), F.min_by(created, seq).alias("_created"))
    live = bronze.join(last.hint(join) if join else last, key).filter(F.col("_reset").isNull() | (F.col(seq) >= F.col("_reset")))
    rank = F.struct(F.when(~blank(F.col(updated)), F.col(updated)).alias("u"), (-F.col(seq)).alias("s"))
    best = live.groupBy(key).agg(F.max_by(F.struct(*[c for c in bronze.columns if c != key]), rank).alias("v"), F.first("_created").alias("_created"))
    rest = [F.col("_created").alias(created) if c == created else F.col(f"v.`{c}`").alias(c) for c in bronze.columns if c != key]
    return best.select(key, *rest)


def last_children(messages: DataFrame, keys: tuple[str, str] = ("conv_key", "native_id"), pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Messages by key, the last of equal keys; and messages without a native_id, which are set aside."""
    whole = messages.filter(F.col(keys[1]).isNotNull())
    rest = [c for c in messages.columns if c not in keys]
    best = whole.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("v"))
    return best.select(*keys, "v.*"), messages.filter(F.col(keys[1]).isNull())


def path_ids(ids: Column, parents: Column, leaf: Column) -> Column:
    """Ids from a leaf to its root, empty for an unknown leaf.

    Of equal ids the last one's parent counts; null ids are on no path; a cycle ends where it would close. A log mostly lists
    parents before their children, so one pass from its end finds the path; where parents come later, passes repeat
    from the place that is left.
    """
    none = F.array().cast("array<string>")
    backward = F.reverse(ids)
    nodes = F.reverse(F.arrays_zip(ids.alias("id"), parents.alias("up")))
    # the first of equal ids from the end; without repeated ids nothing is looked for
    last = F.filter(nodes, lambda n, i: F.array_position(backward, n["id"]) == i + 1)
    nodes = F.when(F.size(F.array_distinct(ids)) < F.size(ids), last).otherwise(nodes)

    def step(state: Column, node: Column) -> Column:
        here = F.coalesce(node["id"] == state["at"], F.lit(False))
        path = F.when(here, F.concat(state["path"], F.array(node["id"]))).otherwise(state["path"])
        return F.struct(F.when(here, node["up"]).otherwise(state["at"]).alias("at"), path.alias("path"))

    def walk(state: Column, _: Column) -> Column:
        again = state["at"].isNotNull() & F.coalesce(F.array_contains(ids, state["at"]), F.lit(False)) & ~F.coalesce(F.array_contains(state["path"], state["at"]), F.lit(False))
        return F.when(again, F.aggregate(nodes, state, step)).otherwise(state)

    start = F.struct(leaf.cast("string").alias("at"), none.alias("path"))
    # each pass finds one message at least, and most find them all
    passes = F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)))
    return F.when(F.size(ids) > 0, F.array_distinct(F.aggregate(passes, start, walk, lambda s: s["path"]))).otherwise(none)


#: Messages of a conversation up to which its path is walked inside one row; longer threads double pointers between rows.
WALKED = 4096


def long_path(links: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv_key, native_id) of the messages from each leaf to its root, in rounds that follow the logarithm of a thread's length.

    ``links(conv_key, native_id, parent_native_id)`` has an id once. A message knows its ancestor 1, 2, 4 ... steps up; in each round
    what is on the path adds its ancestors at that distance, so no row holds a thread. A parent that is missing is a root, and a
    cycle adds nothing after its messages are there. Each round is a table.
    """
    scratch = Scratch(links.sparkSession)
    known = links.select("conv_key", F.col("native_id").alias("up"))
    # only parents that exist are stepped to
    jumps = links.filter("parent_native_id is not null").select("conv_key", F.col("native_id").alias("id"), F.col("parent_native_id").alias("up")).join(known, ["conv_key", "up"], "left_semi").select("conv_key", "id", "up")
    jumps = scratch.stored(jumps, "jumps")
    on = scratch.stored(leaves.select("conv_key", F.col("leaf").cast("string").alias("id")).join(links.select("conv_key", F.col("native_id").alias("id")), ["conv_key", "id"], "left_semi").distinct(), "path")
    n = on.count()
    while True:
        grown = scratch.stored(on.unionByName(on.join(jumps, ["conv_key", "id"]).select("conv_key", F.col("up").alias("id"))).distinct(), "path")
        now = grown.count()
        if now == n:
            break
        on, n = grown, now
        further = jumps.select("conv_key", F.col("id").alias("up"), F.col("up").alias("next"))
        jumps = scratch.stored(jumps.join(further, ["conv_key", "up"]).select("conv_key", "id", F.col("next").alias("up")), "jumps")
    scratch.drop(on)
    return on.select("conv_key", F.col("id").alias("native_id"))


def mark_active(messages: DataFrame, leaves: DataFrame, all_without_leaf: bool = True, walked: int = WALKED) -> DataFrame:
    """Messages with on_active_path. ``leaves(conv_key, leaf)``; without a known leaf all messages are active, or none.

    Conversations of up to ``walked`` messages are walked inside a row each, so they cost one shuffle; longer ones by ``long_path``.
    """
    order = ["pos"] if "pos" in messages.columns else []
    sizes = messages.groupBy("conv_key").agg(F.count("*").alias("_n"))
    # few conversations are long, but nothing bounds how many
    long_keys = sizes.filter(F.col("_n") > walked).select("conv_key")
    some = not long_keys.isEmpty()
    short = messages.join(long_keys, "conv_key", "left_anti") if some else messages
    links = short.groupBy("conv_key").agg(F.array_sort(F.collect_list(F.struct(*order, "native_id", "parent_native_id"))).alias("m"))
    found = links.join(leaves, "conv_key", "left").select("conv_key", path_ids(F.col("m.native_id"), F.col("m.parent_native_id"), F.col("leaf")).alias("path"))
    active = F.when(F.size("path") > 0, F.coalesce(F.array_contains("path", F.col("native_id")), F.lit(False))).otherwise(F.lit(all_without_leaf))
    out = short.join(found, "conv_key").withColumn("on_active_path", active).drop("path")
    if not some:
        return out
    rest = messages.join(long_keys, "conv_key", "left_semi")
    # of equal ids the last one's parent counts
    place = F.struct(*order, "parent_native_id") if order else F.struct("parent_native_id")
    once = rest.filter("native_id is not null").groupBy("conv_key", "native_id").agg(F.max_by("parent_native_id", place).alias("parent_native_id"))
    path = long_path(stored(once, "links"), leaves).withColumn("_on", F.lit(True))
    led = path.select("conv_key").distinct().withColumn("_led", F.lit(True))
    rest = rest.join(path, ["conv_key", "native_id"], "left").join(led, "conv_key", "left")
    marked = F.when(F.col("_led"), F.coalesce("_on", F.lit(False))).otherwise(F.lit(all_without_leaf))
    return out.unionByName(rest.withColumn("on_active_path", marked).select(*out.columns))


def branch_stats(messages: DataFrame) -> DataFrame:
    """conv_key, message_count, branch_points (present parents with several children), abandoned (off the active path)."""
    kids = messages.filter("parent_native_id is not null").groupBy("conv_key", F.col("parent_native_id").alias("native_id")).agg(F.count("*").alias("kids")).filter("kids > 1")
    points = kids.join(messages.select("conv_key", "native_id"), ["conv_key", "native_id"], "left_semi").groupBy("conv_key").agg(F.count("*").alias("branch_points"))
    totals = messages.groupBy("conv_key").agg(F.count("*").alias("message_count"), F.count_if(~F.col("on_active_path")).alias("abandoned"))
    return totals.join(points, "conv_key", "left").withColumn("branch_points", F.coalesce("branch_points", F.lit(0)))


def write_archive(records: DataFrame, path: str) -> None:
    """Append raw records to the archive, by source and month of ingest; every version stays."""
    records.write.mode("append").partitionBy("source", "ingest_month").json(path)


def newest_version_times(bronze: DataFrame, key: str = "key") -> DataFrame:
    """Versions of each key in order of arrival with the timestamp that was stored before each: for audits."""
    w = Window.partitionBy(key).orderBy("seq")
    return bronze.withColumn("before", F.lag("updated_at").over(w))
