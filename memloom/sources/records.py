"""Readers of provider exports, all into one record shape: conversation, messages, stats.

JSON values of open shape stay JSON text: reading a string from an object gives its text, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import content_hash, iso_from_epoch, normal_role, project_name, redact, redact_json
from memloom.operators.store import path_ids

BLOCK = "struct<type:string,text:string,summaries:array<string>,tool_name:string,input:string,content:string,is_error:boolean,redacted:boolean,modality:string,citations:string,start_timestamp:string,stop_timestamp:string,raw:map<string,string>>"

CLAUDE = "struct<uuid:string,name:string,summary:string,model:string,project_uuid:string,created_at:string,updated_at:string,current_leaf_message_uuid:string,chat_messages:array<struct<uuid:string,parent_message_uuid:string,sender:string,created_at:string,updated_at:string,truncated:boolean,attachments:array<struct<extracted_content:string>>,files:array<struct<extracted_content:string>>,content:array<string>>>>"
CHATGPT = "struct<conversation_id:string,title:string,default_model_slug:string,gizmo_id:string,conversation_template_id:string,create_time:double,update_time:double,current_node:string,mapping:map<string,struct<parent:string,message:struct<author:struct<role:string>,create_time:double,update_time:double,content:string,metadata:struct<model_slug:string,is_visually_hidden_from_conversation:boolean>>>>>"
SESSION = "struct<type:string,uuid:string,parentUuid:string,isSidechain:boolean,timestamp:string,cwd:string,gitBranch:string,aiTitle:string,message:struct<role:string,model:string,content:string>>"

_EMPTY = "cast(array() as array<string>)"


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once, however often ``use`` reads it; within lambdas Spark would compute it each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def block(**fields: Column) -> Column:
    """A content block with the given fields, null elsewhere."""
    kinds = {name: kind for name, kind in (x.split(":", 1) for x in BLOCK[7:-1].replace("map<string,string>", "map<string;string>").split(","))}
    return F.struct(*[fields.get(n, F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in kinds.items()])


def raw_fields(text: Column, drop: str) -> Column:
    """Fields of a JSON object as a map to their JSON text, without nulls and without ``drop``."""
    return F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: (k != drop) & v.isNotNull())


def summary_texts(items: Column) -> Column:
    """Summaries given as strings or as objects with a summary."""
    return F.transform(items, lambda s: F.coalesce(F.get_json_object(s, "$.summary"), s))


def web_block(text: Column) -> Column:
    """Normalise one block of a web export: text, thinking, tool use, tool result; others are kept raw."""
    return let(F.from_json(text, "struct<type:string,text:string,thinking:string,citations:string,summaries:array<string>,thinking_hidden:boolean,start_timestamp:string,stop_timestamp:string,name:string,input:string,content:string,is_error:boolean>"), lambda b: _web_block(text, b))


def _web_block(text: Column, b: Column) -> Column:
    kind = F.coalesce(b["type"], F.lit("unknown"))
    summaries = summary_texts(b["summaries"])
    plain = block(type=F.lit("text"), text=F.coalesce(text, F.lit("")))
    return (
        F.when(b["type"].isNull() & ~F.startswith(F.ltrim(text), F.lit("{")), plain)
        .when(kind == "text", block(type=kind, text=F.coalesce(b["text"], F.lit("")), citations=F.when(b["citations"] != "[]", b["citations"])))
        .when(kind == "thinking", block(type=kind, text=F.coalesce(F.nullif(b["thinking"], F.lit("")), b["text"], F.lit("")), start_timestamp=b["start_timestamp"], stop_timestamp=b["stop_timestamp"], summaries=F.when(F.size(summaries) > 0, summaries), redacted=F.when(b["thinking_hidden"], F.lit(True))))
        .when(kind == "tool_use", block(type=kind, tool_name=F.coalesce(b["name"], F.lit("")), input=F.coalesce(b["input"], F.lit("{}"))))
        .when(kind == "tool_result", block(type=kind, tool_name=F.coalesce(b["name"], F.lit("")), content=F.coalesce(b["content"], F.lit("[]")), is_error=F.coalesce(b["is_error"], F.lit(False))))
        .otherwise(block(type=kind, raw=raw_fields(text, "type")))
    )


def node_blocks(text: Column) -> Column:
    """Blocks of a node's content in the mapping format, by its content_type."""
    return let(F.from_json(text, "struct<content_type:string,parts:array<string>,thoughts:array<struct<summary:string,content:string>>,content:string,language:string,text:string,response_format_name:string>"), lambda c: _node_blocks(text, c))


def _node_blocks(text: Column, c: Column) -> Column:
    kind = F.coalesce(c["content_type"], F.lit("unknown"))
    is_object = lambda p: F.startswith(p, F.lit("{")) & F.from_json(p, "map<string,string>").isNotNull()
    strings = F.filter(c["parts"], lambda p: p.isNotNull() & ~is_object(p))
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    none = F.expr(_EMPTY)
    summaries = F.coalesce(F.transform(F.filter(c["thoughts"], lambda t: filled(t["summary"])), lambda t: t["summary"]), none)
    thoughts = F.coalesce(F.transform(F.filter(c["thoughts"], lambda t: filled(t["content"])), lambda t: t["content"]), none)

    def part(p: Column) -> Column:
        spoken = (F.get_json_object(p, "$.content_type") == "audio_transcription") & filled(F.get_json_object(p, "$.text"))
        other = block(type=F.coalesce(F.get_json_object(p, "$.content_type"), F.lit("asset")), raw=F.map_filter(F.from_json(p, "map<string,string>"), lambda _, v: v.isNotNull()))
        return F.when(~is_object(p), block(type=F.lit("text"), text=p)).when(spoken, block(type=F.lit("text"), text=F.get_json_object(p, "$.text"), modality=F.lit("voice"))).otherwise(other)

    output = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c["text"], F.lit("")).alias("text"))))
    code = F.to_json(F.struct(c["language"].alias("language"), F.coalesce(c["text"], F.lit("")).alias("code")))
    return (
        F.when(kind == "text", F.array(block(type=kind, text=F.array_join(F.coalesce(strings, none), "\n"))))
        .when(kind == "thoughts", F.array(block(type=F.lit("thinking"), text=F.array_join(thoughts, "\n"), summaries=F.when(F.size(summaries) > 0, summaries))))
        .when(kind == "reasoning_recap", F.array(block(type=F.lit("thinking"), text=F.lit(""), summaries=F.array(F.coalesce(c["content"], F.lit(""))))))
        .when(kind == "code", F.array(block(type=F.lit("tool_use"), tool_name=F.coalesce(F.nullif(c["response_format_name"], F.lit("")), F.concat(F.lit("code:"), F.coalesce(c["language"], F.lit("")))), input=code)))
        .when(kind == "execution_output", F.array(block(type=F.lit("tool_result"), tool_name=F.lit("code"), content=output, is_error=F.lit(False))))
        .when(kind == "multimodal_text", F.transform(F.filter(c["parts"], lambda p: p.isNotNull()), part))
        .otherwise(F.array(block(type=kind, raw=raw_fields(text, "content_type"))))
    )


def session_blocks(content: Column) -> Column:
    """Blocks of a coding session's message, secrets masked; plain strings are one text block."""
    items = F.from_json(content, "array<string>")
    # a string stands as itself, an object or array as its JSON text
    masked = lambda v: F.when(v.rlike(r"^\s*[\[{]"), redact_json(v)).otherwise(redact(v))

    def one(text: Column) -> Column:
        b = F.from_json(text, "struct<type:string,text:string,thinking:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>")
        kind = F.coalesce(b["type"], F.lit("unknown"))
        none = F.lit("")
        return (
            F.when(kind == "text", block(type=kind, text=redact(F.coalesce(b["text"], none))))
            .when(kind == "thinking", block(type=kind, text=redact(F.coalesce(b["thinking"], none))))
            .when(kind == "tool_use", block(type=kind, tool_name=F.coalesce(b["name"], none), input=redact_json(F.coalesce(b["input"], F.lit("{}")))))
            .when(kind == "tool_result", block(type=kind, tool_name=F.coalesce(b["tool_use_id"], none), content=masked(F.coalesce(b["content"], F.lit("[]"))), is_error=F.coalesce(b["is_error"], F.lit(False))))
            .otherwise(block(type=kind, raw=F.transform_values(raw_fields(text, "type"), lambda _, v: masked(v))))
        )

    is_list = F.startswith(F.ltrim(content), F.lit("[")) & items.isNotNull()
    listed = F.transform(F.filter(items, lambda x: F.startswith(x, F.lit("{"))), one)
    return F.when(content.isNull(), F.array().cast(f"array<{BLOCK}>")).when(is_list, listed).otherwise(F.array(block(type=F.lit("text"), text=redact(content))))


def flat_text(blocks: Column, tools: bool = False, summaries: bool = True) -> Column:
    """Text of blocks joined by newlines: text, thinking and its summaries; with ``tools`` a placeholder for each tool block."""
    none = F.expr(_EMPTY)

    def texts(b: Column) -> Column:
        spoken = F.concat(F.array(F.coalesce(b["text"], F.lit(""))), F.coalesce(b["summaries"], none) if summaries else none)
        mark = F.array(F.concat(F.lit("["), b["type"], F.lit(":"), F.coalesce(b["tool_name"], F.lit("")), F.lit("]")))
        return F.when(b["type"].isin("text", "thinking"), spoken).when(b["type"].isin("tool_use", "tool_result") & F.lit(tools), mark).otherwise(none)

    return F.array_join(F.filter(F.flatten(F.transform(blocks, texts)), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


def search_text(blocks: Column, attachments: Column) -> Column:
    """What full-text search sees of a message: its texts and the extracted text of its attachments."""
    extra = F.filter(F.transform(attachments, lambda a: a["extracted_content"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.concat_ws("\n", F.nullif(flat_text(blocks), F.lit("")), F.nullif(F.array_join(F.coalesce(extra, F.expr(_EMPTY)), "\n"), F.lit("")))


def prompt_text(blocks: Column, cut: int = 1_200) -> Column:
    """What extraction sees: texts, and thinking as a note of its summaries, cut with a marker."""
    note = lambda b: F.concat(F.lit("(thinking: "), F.array_join(b["summaries"], "; "), F.lit(")"))
    each = F.transform(blocks, lambda b: F.when((b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""), b["text"]).when((b["type"] == "thinking") & (F.size(b["summaries"]) > 0), note(b)))
    text = F.array_join(F.filter(each, lambda t: t.isNotNull()), "\n")
    return F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit(" [...truncated]"))).otherwise(text)


def _documents(raw: DataFrame, kind: str) -> DataFrame:
    """Conversations of JSON texts (column value) that hold one conversation or an array of them."""
    many = F.from_json("value", f"array<{kind}>")
    one = F.array(F.from_json("value", kind))
    return raw.select(F.explode(F.when(F.startswith(F.ltrim("value"), F.lit("[")), many).otherwise(one)).alias("c")).filter("c is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts (column value)."""
    return spark.read.text(path, wholetext=True)


def claude_records(raw: DataFrame) -> DataFrame:
    """Records of web exports with a flat list of messages; without a leaf pointer every message is active."""
    rows = _documents(raw, CLAUDE)

    def message(m: Column) -> Column:
        return let(F.transform(m["content"], web_block), lambda blocks: whole(m, blocks))

    def whole(m: Column, blocks: Column) -> Column:
        role = normal_role(m["sender"])
        none = F.array().cast("array<struct<extracted_content:string>>")
        return F.struct(
            m["uuid"].alias("native_id"), m["parent_message_uuid"].alias("parent_native_id"), role.alias("role"), m["created_at"].alias("created_at"), m["updated_at"].alias("updated_at"),
            blocks.alias("content"), content_hash(role, flat_text(blocks, tools=True)).alias("content_hash"), F.lit(None).cast("string").alias("model"), F.lit(False).alias("hidden"),
            F.coalesce(m["truncated"], F.lit(False)).alias("truncated"), F.concat(F.coalesce(m["attachments"], none), F.coalesce(m["files"], none)).alias("attachments"),
        )

    rows = rows.withColumn("messages", F.transform(F.coalesce(F.col("c.chat_messages"), F.from_json(F.lit("[]"), CLAUDE[CLAUDE.index("array<struct<uuid") : -1])), message))
    path = path_ids(F.col("messages.native_id"), F.col("messages.parent_native_id"), F.col("c.current_leaf_message_uuid"))
    return _record(rows.withColumn("path", path), "claude.ai", "uuid", "name", "model", F.col("c.project_uuid"), F.col("c.created_at"), F.col("c.updated_at"), F.col("c.current_leaf_message_uuid"), True)


def chatgpt_records(raw: DataFrame) -> DataFrame:
    """Records of exports with a mapping of nodes; the active path walks through nodes without a message too."""
    rows = _documents(raw, CHATGPT).withColumn("nodes", F.map_entries("c.mapping"))

    def message(e: Column) -> Column:
        return let(node_blocks(e["value"]["message"]["content"]), lambda blocks: whole(e, blocks))

    def whole(e: Column, blocks: Column) -> Column:
        m = e["value"]["message"]
        role = F.coalesce(m["author"]["role"], F.lit("unknown"))
        return F.struct(
            e["key"].alias("native_id"), e["value"]["parent"].alias("parent_native_id"), role.alias("role"), iso_from_epoch(m["create_time"]).alias("created_at"), iso_from_epoch(m["update_time"]).alias("updated_at"),
            blocks.alias("content"), content_hash(role, flat_text(blocks, tools=True)).alias("content_hash"), m["metadata"]["model_slug"].alias("model"), F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False)).alias("hidden"),
            F.lit(False).alias("truncated"), F.array().cast("array<struct<extracted_content:string>>").alias("attachments"),
        )

    rows = rows.withColumn("messages", F.transform(F.filter("nodes", lambda e: e["value"]["message"].isNotNull()), message))
    path = path_ids(F.col("nodes.key"), F.transform("nodes", lambda e: e["value"]["parent"]), F.col("c.current_node"))
    project = F.coalesce("c.conversation_template_id", "c.gizmo_id")
    return _record(rows.withColumn("path", path), "chatgpt.com", "conversation_id", "title", "default_model_slug", project, iso_from_epoch(F.col("c.create_time")), iso_from_epoch(F.col("c.update_time")), F.col("c.current_node"), False)


def _record(rows: DataFrame, source: str, native: str, title: str, model: str, project: Column, created: Column, updated: Column, leaf: Column, all_without_leaf: bool) -> DataFrame:
    active = lambda m: F.when(F.size("path") > 0, F.array_contains("path", m["native_id"])).otherwise(F.lit(all_without_leaf))
    rows = rows.withColumn("messages", F.transform("messages", lambda m: m.withField("on_active_path", F.coalesce(active(m), F.lit(False)))))
    ids = F.col("messages.native_id")
    parents = F.filter(F.col("messages.parent_native_id"), lambda p: p.isNotNull() & F.array_contains(ids, p))
    points = F.filter(F.array_distinct(parents), lambda p: F.size(F.filter(parents, lambda q: q == p)) > 1)
    conversation = F.struct(
        F.lit(source).alias("source"), F.col(f"c.{native}").alias("native_id"), F.coalesce(F.col(f"c.{title}"), F.lit("")).alias("title"), F.col(f"c.{model}").alias("model"),
        project.alias("project_native_id"), created.alias("created_at"), updated.alias("updated_at"), leaf.alias("current_leaf_native_id"),
    )
    stats = F.struct(F.size("messages").alias("message_count"), F.size(points).alias("branch_points"), F.size(F.filter("messages", lambda m: ~m["on_active_path"])).alias("abandoned_messages"))
    return rows.select(F.lit(1).alias("schema_version"), conversation.alias("conversation"), "messages", stats.alias("stats"))


def session_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of local session logs (<root>/<project>/<session>.jsonl): project, session, line_no by byte order, value."""
    rows = spark.read.text(f"{root}/*/*.jsonl").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    piece = F.split("path", "/")
    return rows.select(F.element_at(piece, -2).alias("project"), F.regexp_replace(F.element_at(piece, -1), r"\.jsonl$", "").alias("session"), "block", "at", "value")


def session_records(lines: DataFrame) -> DataFrame:
    """One record for each session of ``lines(project, session, block, at, value)``.

    Side chains, bookkeeping and broken lines are left out, a repeated uuid counts once, turns without one count each, the last
    title wins, model and directory are the most frequent (the first of equals), and messages keep the order of the log.
    """
    rows = lines.withColumn("e", F.from_json("value", SESSION)).filter("e is not null").withColumn("ord", F.struct("block", "at"))
    key = ["project", "session"]
    title = rows.filter((F.col("e.type") == "ai-title") & (F.coalesce("e.aiTitle", F.lit("")) != "")).groupBy(*key).agg(F.max_by("e.aiTitle", "ord").alias("title"))
    turns = rows.filter(F.col("e.type").isin("user", "assistant") & ~F.coalesce("e.isSidechain", F.lit(False))).withColumn("blocks", session_blocks(F.col("e.message.content"))).filter(F.size("blocks") > 0)
    named = F.nullif("e.uuid", F.lit(""))
    # a turn without a uuid is known by its place
    own = F.when(named.isNull(), F.col("ord"))
    once = turns.groupBy(*key, named.alias("uuid"), own.alias("own")).agg(F.min_by(F.struct("ord", "e", "blocks"), "ord").alias("v")).select(*key, "uuid", "v.*")
    role = F.coalesce("e.message.role", "e.type")
    shaped = once.withColumn("m", F.struct("ord", F.col("uuid").alias("native_id"), F.col("e.parentUuid").alias("parent_native_id"), role.alias("role"), F.col("e.timestamp").alias("created_at"), F.col("blocks").alias("content"), content_hash(role, flat_text(F.col("blocks"), summaries=False)).alias("content_hash"), F.col("e.message.model").alias("model")))
    modal = lambda c: _modal(once.select(*key, "ord", F.col(c).alias("x")), key)
    out = shaped.groupBy(*key).agg(F.array_sort(F.collect_list("m"), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("messages"), F.max_by("e.gitBranch", F.when(F.col("e.gitBranch").isNotNull(), F.col("ord"))).alias("git_branch"))
    out = out.join(title, key, "left").join(modal("e.message.model").withColumnRenamed("x", "model"), key, "left").join(modal("e.cwd").withColumnRenamed("x", "cwd"), key, "left")
    shown = F.concat(project_name(F.col("project")), F.lit(" / "), F.coalesce(F.nullif(redact(F.col("title")), F.lit("")), F.lit("untitled session")))
    return out.select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("coding-session:"), "session").alias("key"), shown.alias("title"), "model", "cwd", "git_branch", F.col("project").alias("project_native_id"),
        F.element_at("messages", 1)["created_at"].alias("created_at"), F.element_at("messages", -1)["created_at"].alias("updated_at"), F.element_at("messages", -1)["native_id"].alias("current_leaf_native_id"),
        F.transform("messages", lambda m: m.dropFields("ord")).alias("messages"), F.size("messages").alias("message_count"),
    )


def _modal(rows: DataFrame, key: list[str]) -> DataFrame:
    """The most frequent value x of each key, the first seen of equals."""
    counts = rows.filter("x is not null").groupBy(*key, "x").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "x"))["x"].alias("x"))


def attribute(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Records with an attribution: the owner of the conversation's project, or unknown. ``owners(project_native_id, owner)``.

    Attribution is never guessed: without a rule for its project a conversation's owner stays unknown.
    """
    rule = owners.filter(F.coalesce("owner", F.lit("")) != "").groupBy("project_native_id").agg(F.min("owner").alias("_owner")).withColumnRenamed("project_native_id", "_project")
    rows = records.join(rule, F.nullif("conversation.project_native_id", F.lit("")) == F.col("_project"), "left")
    ruled = F.col("_owner").isNotNull()
    found = F.struct(F.coalesce("_owner", F.lit("unknown")).alias("owner"), F.when(ruled, "project-rule").alias("method"), F.when(ruled, 1.0).otherwise(0.0).alias("confidence"))
    return rows.withColumn("attribution", found).drop("_owner", "_project")


def bronze(records: DataFrame) -> DataFrame:
    """Accepted records as versions for ``store.newest_wins``: key, updated_at, created_at, title, model, message_count, record."""
    c = "conversation"
    return records.select(
        F.concat(f"{c}.source", F.lit(":"), f"{c}.native_id").alias("key"), F.col(f"{c}.updated_at").alias("updated_at"), F.col(f"{c}.created_at").alias("created_at"),
        F.col(f"{c}.title").alias("title"), F.col(f"{c}.model").alias("model"), F.size("messages").alias("message_count"), F.struct("*").alias("record"),
    )


def _each(name: str) -> Column:
    """An array column to explode: of a plain column Spark infers a filter on its size, for which it would make the array a second time."""
    return F.filter(name, lambda _: F.lit(True))


def message_rows(records: DataFrame) -> DataFrame:
    """Messages of records: conv_key, pos, the message's fields, and the text that search sees."""
    rows = records.select(F.concat("conversation.source", F.lit(":"), "conversation.native_id").alias("conv_key"), F.posexplode(_each("messages")).alias("pos", "m"))
    return rows.select("conv_key", "pos", "m.*", search_text(F.col("m.content"), F.col("m.attachments")).alias("text"))


def gate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): records of schema version 1 with a source and a native id, and all others."""
    good = F.coalesce((F.col("schema_version") == 1) & F.col("conversation.source").isNotNull() & F.col("conversation.native_id").isNotNull(), F.lit(False))
    return records.filter(good), records.filter(~good)


def summary(records: DataFrame) -> DataFrame:
    """Messages by role and blocks by type: what, name, n."""
    # both kinds of rows leave a message at once: records are read, and their blocks made, one time
    counted = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    m = records.select(F.explode(_each("messages")).alias("m"))
    blocks = F.coalesce(F.transform("m.content", lambda b: counted("block", b["type"])), F.array().cast("array<struct<what:string,name:string>>"))
    rows = m.select(F.inline(F.concat(F.array(counted("role", F.col("m.role"))), blocks)))
    return rows.groupBy("what", "name").agg(F.count("*").alias("n"))
