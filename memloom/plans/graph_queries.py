"""Entities, edges, typing, feeds, timelines and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.operators import communities, edges, extraction, resolve
from memloom.operators.edge_view import EdgeView
from memloom.operators.tables import new_path, stored
from memloom.sources import views as v


def graph(spark, sf, evidence_cap=20):
    return edges.edges(v.mentions(spark, sf).select("conv_key", "chunk_idx", "entity_id", "day"), v.assertions(spark, sf), evidence_cap=evidence_cap)


def light(spark, sf):
    """Edges without their evidence."""
    return graph(spark, sf, 0)


NOW = "2024-02-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def typings(g):
    """Typings of edges, twice, of which the last one counts."""
    kind = F.when(F.col("src") % 2 == 0, "works-for").when(F.col("dst") % 2 == 0, "family-of").otherwise("uses")
    way = F.when(F.col("dst") % 5 == 0, "backward").otherwise("forward")
    when = F.when(F.col("src") % 7 == 0, "state").otherwise("enduring")
    at = now() - F.make_dt_interval(secs=(F.col("src") * 7 + F.col("dst")) % 1000)
    first = [F.lit(x).alias(n) for x, n in ((1, "seq"), ("related-to", "relation"), ("undirected", "direction"), ("enduring", "temporality"))]
    last = [F.lit(2).alias("seq"), kind.alias("relation"), way.alias("direction"), when.alias("temporality")]
    early = F.struct(*first, F.lit(None).cast("string").alias("as_of"), F.lit(None).cast("timestamp_ntz").alias("verified_at"))
    late = F.struct(*last, F.when(F.col("src") % 7 == 0, F.col("last_seen")).alias("as_of"), at.alias("verified_at"))
    return g.select("src", "dst", F.inline(F.array(early, late)))


def typed(spark, sf):
    """Edges of which those with ids that add up to a multiple of three are typed; the edges are a table that both sides read."""
    g = stored(light(spark, sf), "edges")
    return edges.apply_typings(g, typings(g.filter("(src + dst) % 3 = 0")))


def guard(spark, sf):
    """Typings of all edges, judged by the evidence that a typer would see."""
    e, g = v.entities(spark, sf), stored(light(spark, sf), "edges")
    pack = edges.evidence_pack(g, v.mentions(spark, sf), v.assertions(spark, sf), v.aliases(spark, sf))
    texts = pack.groupBy("src", "dst").agg(F.collect_list(F.concat_ws(" ", "statement", "rationale")).alias("evidence"))
    t = typings(g).filter("seq = 2").join(texts, ["src", "dst"], "left")
    t = t.join(e.select(F.col("entity_id").alias("src"), F.col("type").alias("src_type")), "src").join(e.select(F.col("entity_id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    return edges.guard_typing(t).select("src", "dst", "relation", "direction", "downgraded")


def pack(spark, sf):
    g = light(spark, sf).filter("weight >= 2")
    return edges.evidence_pack(g, v.mentions(spark, sf), v.assertions(spark, sf), v.aliases(spark, sf)).drop("type", "speaker")


def page(spark, sf):
    """A page with its evidence, a row for each piece of it."""
    rows = edges.typing_page(typed(spark, sf), v.entities(spark, sf), v.mentions(spark, sf), v.assertions(spark, sf), v.aliases(spark, sf), 2, 100, 10)
    return rows.select("src", "dst", "src_name", "dst_name", "weight", "matching_total", F.inline("evidence"))


def typed_by_rule(spark, sf):
    """All edges of weight two and more typed page by page, by a rule in the place of a model: multiples of eleven never get an answer."""

    def typer(rows):
        say = lambda r: {"src": r["src"], "dst": r["dst"], "relation": "uses" if r["weight"] % 2 else "works-for", "direction": "forward", "temporality": "enduring", "as_of": "2024"}
        return [say(r) for r in rows if (r["src"] + r["dst"]) % 11]

    g = edges.apply_typings(stored(light(spark, sf), "edges"), typings(light(spark, sf).limit(0)))
    out = extraction.typing_run(g, v.entities(spark, sf), v.mentions(spark, sf), v.assertions(spark, sf), v.aliases(spark, sf), typer, now())
    return out.select("src", "dst", "verified_relation", "direction", "as_of", "verified")


def resolved_in_tiers(spark, sf):
    return extraction.resolve_run(resolve.candidate_contexts(v.mentions(spark, sf)))


def ends(spark, sf, a, b):
    asked = spark.createDataFrame([(a, "a"), (b, "b")], "name string, side string")
    return resolve.resolve_names(asked.select("name"), v.entities(spark, sf), v.aliases(spark, sf)).join(asked, "name").select("entity_id", "side")


def connects(spark, sf):
    return edges.what_connects(typed(spark, sf), v.entities(spark, sf), ends(spark, sf, "K7", "alias 8"))


def neighbours(spark, sf):
    found = resolve.resolve_names(spark.createDataFrame([("K7",)], "name string"), v.entities(spark, sf), v.aliases(spark, sf))
    return edges.neighbourhood_of(typed(spark, sf), v.entities(spark, sf), found)


def timeline(spark, sf):
    return resolve.timeline("K7", v.entities(spark, sf), v.aliases(spark, sf), v.mentions(spark, sf), v.assertions(spark, sf), v.threads(spark, sf), "Agent ")


def build(spark, sf):
    """Entities of the view as a list to build from; every fiftieth mention is assigned by a split."""
    forms = v.aliases(spark, sf).groupBy("entity_id").agg(F.collect_list("alias").alias("aliases"))
    listed = v.entities(spark, sf).join(forms, "entity_id").select((F.col("entity_id") + 1000).alias("seq"), "canonical", "type", "mentions", "aliases")
    m = v.mentions(spark, sf)
    splits = m.filter("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, "k1").otherwise("unknown").alias("canonical"))
    return resolve.build_entities(listed, m, splits)


def chunk_days(spark, sf):
    m = v.mentions(spark, sf)
    return resolve.chunk_mentions(m, m.select("id", "entity_id"), v.threads(spark, sf))


def listed_communities(spark, sf):
    """Communities by the last digit of entity ids, of which 3 and 13 list the same."""
    e = v.entities(spark, sf)
    digit = (F.col("entity_id") % 10).cast("int")
    one = e.groupBy(digit.alias("community_id")).agg(F.collect_list("entity_id").alias("entity_ids"))
    again = one.filter("community_id = 3").select(F.lit(13).alias("community_id"), "entity_ids")
    rows = one.unionByName(again)
    return communities.store_communities(rows.select(F.col("community_id").alias("seq"), "community_id", F.concat(F.lit("theme "), "community_id").alias("label"), "entity_ids"))


def renamed(spark, sf):
    names_ = spark.createDataFrame([(3, 1, "first"), (3, 2, "second"), (99, 1, "none")], "community_id int, seq int, label string")
    return communities.rename(listed_communities(spark, sf)[0], names_)


def feed_nodes(spark, sf):
    c, m = listed_communities(spark, sf)
    return edges.feed_nodes(edges.feed(typed(spark, sf), v.entities(spark, sf), 3)[1], c, m)


def feed(spark, sf, depth):
    m = v.mentions(spark, sf)
    links, nodes = edges.feed(typed(spark, sf), v.entities(spark, sf), 3)
    if depth == 0:
        return links
    return edges.feed_pieces(nodes, m, 4) if depth == 1 else edges.feed_assertions(nodes, m, v.assertions(spark, sf), 4)


def names(spark, sf):
    return spark.createDataFrame([("K7",), ("g3",), ("Alias 5",), ("k1",), ("nobody",)], "name string")


def resolutions(spark, sf):
    """Resolutions of part names: each tenth skipped, each seventh split in two."""
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_brand").alias("canonical"), F.col("p_size").cast("long").alias("mentions"), F.col("p_type").alias("type"))
    split = F.when(F.col("seq") % 7 == 0, F.array(F.col("canonical"), F.concat(F.lit(" "), F.lower("canonical"), F.lit("  x ")))).otherwise(F.array().cast("array<string>"))
    return p.select("seq", "name", "canonical", F.when(F.col("seq") % 3 != 0, F.col("type")).alias("type"), (F.col("seq") % 10 == 0).alias("skip"), "mentions", split.alias("split"))


def themes(spark, sf):
    """Communities by entity type stand in for found ones, so the result can be checked."""
    e = v.entities(spark, sf)
    return communities.themes(e.select(F.col("entity_id").alias("node"), F.hash("type").alias("community")), e)


def worksheet(spark, sf):
    rows = resolve.candidate_contexts(v.mentions(spark, sf))
    return rows.select("name", "n", "rank", "tier", "batch", F.array_join("contexts", "|").alias("contexts"))


def louvain(spark, sf):
    return communities.louvain(light(spark, sf))


def louvain_quality(spark, sf):
    """What must hold of the communities of all edges: each node in one, all connected, none that a move would better."""
    g = stored(light(spark, sf), "edges")
    return communities.quality(g, communities.louvain(g)).select("nodes", "total", "unplaced", "disconnected", "gaining", (F.col("modularity") >= 0).alias("better_than_one"))


def kept_edges(spark, sf):
    """Edges kept over four submits: half of the days, the other half, some chunks again with other content, some purged."""
    m, said = v.mentions(spark, sf).select("conv_key", "chunk_idx", "entity_id", "day"), v.assertions(spark, sf).select("conv_key", "chunk_idx", "id", "type")
    view = EdgeView(spark, new_path(spark, "edge-view"))
    chunks = lambda test: m.filter(test).select("conv_key", "chunk_idx")
    view.submit(0, chunks("chunk_idx <= 15"), m.withColumn("entity_id", F.col("entity_id") % 40), said)  # an early extraction that saw less
    view.submit(1, chunks("chunk_idx > 15"), m, said)
    view.submit(2, chunks("chunk_idx <= 15"), m, said.withColumn("type", F.when(F.col("id") % 2 == 0, F.col("type"))))
    view.submit(3, chunks("chunk_idx % 5 = 0"), m.limit(0), said)
    return view.table().select("src", "dst", "weight", "relation", "first_seen", "last_seen", F.array_join("evidence", ",").alias("evidence"))


def suppliers(spark, sf):
    """Suppliers that share an order, as edges: the large graph."""
    rows = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conv_key"), F.lit(0).alias("chunk_idx"), F.col("l_suppkey").alias("entity_id"), F.lit("").alias("day"))
    return edges.chunk_pairs(edges.chunk_entities(edges.dealt(rows))).groupBy("src", "dst").agg(F.count("*").alias("weight"))


QUERIES = {
    "edges_cooccurrence": lambda s, d: light(s, d),
    "edge_evidence": lambda s, d: graph(s, d).select("src", "dst", F.array_join("evidence", ",").alias("evidence")),
    "edge_view": kept_edges,
    "edges_topk": lambda s, d: edges.top_edges(light(s, d), 50).select("src", "dst", "weight"),
    "edges_min_weight": lambda s, d: light(s, d).filter("weight >= 3").select("src", "dst", "weight"),
    "edge_dump": lambda s, d: light(s, d).select("src", "dst", "weight"),
    "edge_evidence_pack": pack,
    "neighborhood": neighbours,
    "what_connects": connects,
    "timeline": timeline,
    "typing_page": page,
    "typing_run": typed_by_rule,
    "resolve_run": resolved_in_tiers,
    "entity_build": lambda s, d: build(s, d)[2],
    "entity_build_ids": lambda s, d: build(s, d)[0],
    "chunk_mentions": chunk_days,
    "store_communities": lambda s, d: listed_communities(s, d)[1],
    "rename_community": renamed,
    "graph_feed_nodes": feed_nodes,
    "graph_feed_totals": lambda s, d: edges.feed_totals(v.mentions(s, d), v.assertions(s, d)),
    "recent_typings": lambda s, d: edges.recent_typings(typed(s, d).filter("verified")).select("src", "dst", "verified_relation", "weight", F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at")),
    "resolve_entity": lambda s, d: resolve.resolve_names(names(s, d), v.entities(s, d), v.aliases(s, d)),
    "alias_map": lambda s, d: resolve.alias_map(v.mentions(s, d), v.aliases(s, d), v.mentions(s, d).filter("id % 50 = 0").select("id", F.lit(1).cast("long").alias("entity_id"))),
    "entity_list": lambda s, d: resolve.entity_list(v.entities(s, d), resolve.alias_map(v.mentions(s, d), v.aliases(s, d))),
    "assemble_entities": lambda s, d: resolve.assemble(resolutions(s, d)).select("key", "canonical", "type", "mentions", F.size("aliases").alias("n_aliases")),
    "near_duplicates": lambda s, d: resolve.near_duplicate_names(v.entities(s, d)),
    "resolution_worksheet": worksheet,
    "typing_guard": guard,
    "set_edge_types": lambda s, d: typed(s, d).select("src", "dst", "verified_relation", "direction", "temporality", "as_of", "verified", F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at")),
    "typing_status": lambda s, d: edges.typing_status(typed(s, d), now()),
    "edge_sentences": lambda s, d: edges.rendered(typed(s, d), v.entities(s, d)).select("src", "dst", "sentence"),
    "graph_feed_d0": lambda s, d: feed(s, d, 0),
    "graph_feed_d1": lambda s, d: feed(s, d, 1),
    "graph_feed_d2": lambda s, d: feed(s, d, 2),
    "list_themes": lambda s, d: themes(s, d)[0].select("label", "size"),
    "theme_members": lambda s, d: communities.theme_members(themes(s, d)[1], v.entities(s, d)).select("rank", "canonical"),
    "theme_of": lambda s, d: themes(s, d)[1].filter("entity_id = 7").join(themes(s, d)[0], "community_id").select("entity_id", "label", "size"),
    "edges_for_typing": lambda s, d: edges.for_typing(typed(s, d), v.entities(s, d), 2, 100, 10),
    "typing_breakdown": lambda s, d: edges.typing_breakdown(typed(s, d)),
    "find_entity": lambda s, d: edges.find_entity(v.entities(s, d), "K1"),
    "node_sizes": lambda s, d: edges.node_sizes(v.entities(s, d)).select("entity_id", "size"),
    "mapped_chunks": lambda s, d: v.mentions(s, d).filter("entity_id = 7").select("conv_key", "chunk_idx").distinct(),
    "supplier_cooccurrence": suppliers,
    "louvain_communities": louvain,
    "louvain_quality": louvain_quality,
}

_e = v.with_views("mentions", "assertions", "threads", "entities", "aliases")
_G = """ch AS (SELECT DISTINCT conv_key, chunk_idx, entity_id FROM v_mentions),
cd AS (SELECT conv_key, chunk_idx, min(day) AS day FROM v_mentions GROUP BY 1, 2),
pr AS (SELECT a.conv_key, a.chunk_idx, a.entity_id AS src, b.entity_id AS dst, cd.day FROM ch a JOIN ch b ON a.conv_key = b.conv_key AND a.chunk_idx = b.chunk_idx AND a.entity_id < b.entity_id
  JOIN cd ON cd.conv_key = a.conv_key AND cd.chunk_idx = a.chunk_idx),
ty AS (SELECT src, dst, type, count(*) AS n FROM pr JOIN v_assertions s USING (conv_key, chunk_idx) GROUP BY 1, 2, 3),
re AS (SELECT src, dst, type AS relation FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, type) AS r FROM ty) WHERE r = 1),
g AS (SELECT src, dst, count(*) AS weight, min(day) AS first_seen, max(day) AS last_seen FROM pr GROUP BY 1, 2),
v_edges AS (SELECT * FROM g JOIN re USING (src, dst))"""
_T = """v_typed AS (SELECT *, CASE WHEN ok THEN CASE WHEN src % 2 = 0 THEN 'works-for' WHEN dst % 2 = 0 THEN 'family-of' ELSE 'uses' END END AS verified_relation,
  CASE WHEN ok THEN CASE WHEN dst % 5 = 0 THEN 'backward' ELSE 'forward' END ELSE 'undirected' END AS direction,
  CASE WHEN ok THEN CASE WHEN src % 7 = 0 THEN 'state' ELSE 'enduring' END END AS temporality, CASE WHEN ok AND src % 7 = 0 THEN last_seen END AS as_of, ok AS verified,
  CASE WHEN ok THEN TIMESTAMP '2024-02-01 12:00:00' - to_seconds((src * 7 + dst) % 1000) END AS verified_at
  FROM (SELECT *, (src + dst) % 3 = 0 AS ok FROM v_edges))"""
_P = """nm AS (SELECT entity_id, lower(alias) AS a FROM v_aliases),
sc AS (SELECT src, dst, conv_key, chunk_idx FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY conv_key, chunk_idx) AS r FROM pr) WHERE r <= 60),
x AS (SELECT src, dst, conv_key, chunk_idx, id, type, speaker, statement, coalesce(rationale, '') AS rationale, lower(statement || ' ' || coalesce(rationale, '')) AS s FROM sc JOIN wanted USING (src, dst) JOIN v_assertions USING (conv_key, chunk_idx)),
y AS (SELECT x.*, (SELECT count(*) FROM nm WHERE nm.entity_id IN (x.src, x.dst) AND contains(x.s, nm.a))::INTEGER AS score FROM x),
v_pack AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, conv_key, chunk_idx, id)::INTEGER AS rank FROM y) WHERE rank <= 7)"""
_W = "CASE WHEN direction = 'backward' THEN 'k' || dst ELSE 'k' || src END || ' ' || coalesce(verified_relation, relation) || ' ' || CASE WHEN direction = 'backward' THEN 'k' || src ELSE 'k' || dst END || CASE WHEN temporality = 'state' AND as_of IS NOT NULL THEN ' (as of ' || as_of || ')' ELSE '' END"
_L = """links AS (SELECT CASE WHEN direction = 'backward' THEN dst ELSE src END AS source_id, CASE WHEN direction = 'backward' THEN src ELSE dst END AS target_id,
  coalesce(verified_relation, relation) AS relation, weight, direction IN ('forward', 'backward') AS directed FROM v_typed WHERE weight >= 3),
nodes AS (SELECT source_id AS entity_id FROM links UNION SELECT target_id FROM links)"""
_S = "sz AS (SELECT type, count(*) AS size FROM v_entities GROUP BY 1 HAVING count(*) >= 3), rk AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY mentions DESC, entity_id) AS r FROM v_entities), lb AS (SELECT type, string_agg(canonical, ' / ' ORDER BY r) AS label FROM rk WHERE r <= 4 GROUP BY 1)"
ORACLES = {
    # modularity is the share of weight inside communities less what chance would give: all in one community has none
    "louvain_quality": f"{_e}, {_G} SELECT (SELECT count(*) FROM (SELECT src FROM v_edges UNION SELECT dst FROM v_edges)) AS nodes, (SELECT sum(weight)::BIGINT FROM v_edges) AS total, 0::BIGINT AS unplaced, 0::BIGINT AS disconnected, 0::BIGINT AS gaining, true AS better_than_one",
    "edges_for_typing": f"{_e}, {_G}, {_T}, p AS (SELECT * FROM v_typed WHERE weight >= 2 AND NOT verified ORDER BY weight DESC, src, dst LIMIT 100 OFFSET 10) SELECT src, dst, a.canonical AS src_name, a.type AS src_type, b.canonical AS dst_name, b.type AS dst_type, weight, relation FROM p JOIN v_entities a ON a.entity_id = src JOIN v_entities b ON b.entity_id = dst",
    "typing_breakdown": f"{_e}, {_G}, {_T} SELECT 'relation' AS what, verified_relation AS name, count(*) AS n FROM v_typed WHERE verified GROUP BY 2 UNION ALL SELECT 'temporality', temporality, count(*) FROM v_typed WHERE verified GROUP BY 2",
    "find_entity": f"{_e} SELECT * FROM v_entities WHERE contains(lower(canonical), 'k1') ORDER BY mentions DESC, entity_id LIMIT 1",
    "node_sizes": f"{_e} SELECT entity_id, round(1 + 7 * sqrt(mentions::DOUBLE / max(mentions) OVER ()), 6) AS size FROM v_entities",
    "mapped_chunks": f"{_e} SELECT DISTINCT conv_key, chunk_idx FROM v_mentions WHERE entity_id = 7",
    "supplier_cooccurrence": "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS e FROM lineitem) SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM s a JOIN s b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2",
    "edges_cooccurrence": f"{_e}, {_G} SELECT * FROM v_edges",
    "edge_evidence": f"""{_e}, {_G}, ra AS (SELECT conv_key, chunk_idx, id, row_number() OVER (PARTITION BY conv_key, chunk_idx ORDER BY id) AS r FROM v_assertions),
ev AS (SELECT src, dst, ra.conv_key AS ck, ra.chunk_idx AS ci, id, row_number() OVER (PARTITION BY src, dst ORDER BY ra.conv_key, ra.chunk_idx, id) AS k FROM pr JOIN ra USING (conv_key, chunk_idx) WHERE r <= 3)
SELECT src, dst, string_agg(id::VARCHAR, ',' ORDER BY k) AS evidence FROM ev WHERE k <= 20 GROUP BY 1, 2""",
    "edge_view": f"""{_e}, m AS (SELECT * FROM v_mentions WHERE chunk_idx % 5 <> 0), s AS (SELECT conv_key, chunk_idx, id, coalesce(CASE WHEN chunk_idx > 15 OR id % 2 = 0 THEN type END, 'related') AS type FROM v_assertions),
ch AS (SELECT DISTINCT conv_key, chunk_idx, entity_id FROM m), cd AS (SELECT conv_key, chunk_idx, min(day) AS day FROM m GROUP BY 1, 2),
pr AS (SELECT a.conv_key, a.chunk_idx, a.entity_id AS src, b.entity_id AS dst, cd.day FROM ch a JOIN ch b ON a.conv_key = b.conv_key AND a.chunk_idx = b.chunk_idx AND a.entity_id < b.entity_id JOIN cd ON cd.conv_key = a.conv_key AND cd.chunk_idx = a.chunk_idx),
ty AS (SELECT src, dst, type, count(*) AS n FROM pr JOIN s USING (conv_key, chunk_idx) GROUP BY 1, 2, 3), re AS (SELECT src, dst, type AS relation FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, type) AS r FROM ty) WHERE r = 1),
g AS (SELECT src, dst, count(*) AS weight, min(day) AS first_seen, max(day) AS last_seen FROM pr GROUP BY 1, 2),
ra AS (SELECT conv_key, chunk_idx, id, row_number() OVER (PARTITION BY conv_key, chunk_idx ORDER BY id) AS r FROM s),
ev AS (SELECT src, dst, id, row_number() OVER (PARTITION BY src, dst ORDER BY ra.conv_key, ra.chunk_idx, id) AS k FROM pr JOIN ra USING (conv_key, chunk_idx) WHERE r <= 3)
SELECT g.*, relation, (SELECT string_agg(id::VARCHAR, ',' ORDER BY k) FROM ev WHERE ev.src = g.src AND ev.dst = g.dst AND k <= 20) AS evidence FROM g JOIN re USING (src, dst)""",
    "edges_topk": f"{_e}, {_G} SELECT src, dst, weight FROM v_edges ORDER BY weight DESC, src, dst LIMIT 50",
    "edges_min_weight": f"{_e}, {_G} SELECT src, dst, weight FROM v_edges WHERE weight >= 3",
    "edge_dump": f"{_e}, {_G} SELECT src, dst, weight FROM v_edges",
    "edge_evidence_pack": f"{_e}, {_G}, wanted AS (SELECT src, dst FROM v_edges WHERE weight >= 2), {_P} SELECT src, dst, rank, id, score, statement, rationale FROM v_pack",
    "typing_page": f"""{_e}, {_G}, {_T}, open AS (SELECT * FROM v_typed WHERE weight >= 2 AND NOT verified), wanted AS (SELECT * FROM open ORDER BY weight DESC, src, dst LIMIT 100 OFFSET 10), {_P}
SELECT src, dst, 'k' || src AS src_name, 'k' || dst AS dst_name, w.weight, (SELECT count(*) FROM open) AS matching_total, rank, p.type, speaker, statement, rationale FROM wanted w JOIN v_pack p USING (src, dst)""",
    "typing_run": f"""{_e}, {_G}, o AS (SELECT e.*, weight >= 2 AND (src + dst) % 11 <> 0 AS ok, weight % 2 <> 0 OR (a.type = 'person' AND b.type = 'org') AS holds, a.type = 'person' AND b.type = 'person' AS persons
  FROM v_edges e JOIN v_entities a ON a.entity_id = src JOIN v_entities b ON b.entity_id = dst)
SELECT src, dst, CASE WHEN ok THEN CASE WHEN weight % 2 <> 0 THEN 'uses' WHEN holds THEN 'works-for' WHEN persons THEN 'discussed-with' ELSE 'related-to' END END AS verified_relation,
CASE WHEN ok AND holds THEN 'forward' ELSE 'undirected' END AS direction, NULL::VARCHAR AS as_of, ok AS verified FROM o""",
    "resolve_run": f"{_e}, t AS (SELECT lower(name) AS name, count(*) AS n FROM v_mentions GROUP BY 1 ORDER BY n DESC, name LIMIT 350), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rank FROM t) SELECT name, name AS canonical, 'topic' AS type, false AS skip, CASE WHEN rank <= 180 THEN 1 ELSE 2 END AS tier, ((rank - 1) // 20)::INTEGER AS batch FROM k",
    "neighborhood": f"{_e}, {_G}, {_T} SELECT src, dst, {_W} AS sentence, weight, first_seen, last_seen FROM v_typed WHERE src = 7 OR dst = 7 ORDER BY weight DESC, src, dst LIMIT 15",
    "what_connects": f"""{_e}, {_G}, {_T}, s AS (SELECT src AS node, dst AS other, weight FROM v_edges UNION ALL SELECT dst, src, weight FROM v_edges),
o AS (SELECT a.other, a.weight + b.weight AS total FROM s a JOIN s b ON a.other = b.other WHERE a.node = 7 AND b.node = 8 AND a.other NOT IN (7, 8) ORDER BY total DESC, a.other LIMIT 15)
SELECT 'direct' AS kind, {_W} AS name, weight, first_seen, last_seen FROM v_typed WHERE src = 7 AND dst = 8 UNION ALL SELECT 'shared', 'k' || other, total, NULL, NULL FROM o""",
    "timeline": f"""{_e}, t AS (SELECT DISTINCT c.created_at, a.type, a.speaker, a.statement, a.conv_key, a.evidence, CASE WHEN len(a.evidence) > 0 THEN a.conv_key || '#' || a.evidence[1] END AS ref
  FROM v_assertions a JOIN v_threads c USING (conv_key) WHERE owner NOT IN ('sealed') AND (a.conv_key, a.chunk_idx) IN (SELECT conv_key, chunk_idx FROM v_mentions WHERE entity_id = 7)
  AND regexp_matches(a.statement, '(?i)\\b(k7|g7|alias 7)\\b') AND a.speaker = 'assistant')
SELECT substr(created_at, 1, 10) AS day, type, speaker, substr(statement, 1, 180) AS statement, ref FROM t ORDER BY created_at, conv_key, ref, type, statement LIMIT 25""",
    "entity_build": f"{_e} SELECT id, CASE WHEN id % 100 = 0 THEN 1 ELSE entity_id END + 1000 AS entity_id FROM v_mentions",
    "entity_build_ids": f"{_e} SELECT entity_id + 1000 AS entity_id, canonical, type, mentions FROM v_entities",
    "chunk_mentions": f"{_e} SELECT id, conv_key, chunk_idx, entity_id, substr(c.created_at, 1, 10) AS day FROM v_mentions JOIN v_threads c USING (conv_key)",
    "store_communities": f"{_e} SELECT entity_id, CASE WHEN entity_id % 10 = 3 THEN 13 ELSE entity_id % 10 END::INTEGER AS community_id FROM v_entities",
    "rename_community": f"{_e} SELECT c::INTEGER AS community_id, CASE WHEN c = 3 THEN 'second' ELSE 'theme ' || c END AS label, n::INTEGER AS size FROM (SELECT entity_id % 10 AS c, count(*) AS n FROM v_entities GROUP BY 1 UNION ALL SELECT 13, count(*) FROM v_entities WHERE entity_id % 10 = 3)",
    "graph_feed_nodes": f"{_e}, {_G}, {_T}, {_L} SELECT entity_id, canonical, type, mentions, (CASE WHEN entity_id % 10 = 3 THEN 13 ELSE entity_id % 10 END)::INTEGER AS community, 'theme ' || CASE WHEN entity_id % 10 = 3 THEN 13 ELSE entity_id % 10 END AS theme FROM v_entities WHERE entity_id IN (SELECT entity_id FROM nodes)",
    "graph_feed_totals": f"{_e} SELECT 1 AS depth, count(*) AS total_pieces FROM v_mentions UNION ALL SELECT 2, count(*) FROM v_assertions",
    "recent_typings": f"{_e}, {_G}, {_T} SELECT src, dst, verified_relation, weight, strftime(verified_at, '%Y-%m-%d %H:%M:%S') AS verified_at FROM v_typed t WHERE verified ORDER BY t.verified_at DESC, src, dst LIMIT 15",
    "resolve_entity": f"""{_e}, q AS (SELECT unnest(['K7', 'g3', 'Alias 5', 'k1', 'nobody']) AS name),
c AS (SELECT name, entity_id, mentions, 1 AS tier FROM q JOIN v_entities ON lower(canonical) = lower(name) UNION ALL SELECT name, entity_id, mentions, 2 FROM q JOIN v_entities ON lower(canonical) LIKE lower(name) || ' %'
  UNION ALL SELECT name, entity_id, mentions, 3 FROM q JOIN v_aliases ON lower(alias) = lower(name) JOIN v_entities USING (entity_id))
SELECT name, entity_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, mentions DESC, entity_id) AS r FROM c) WHERE r = 1""",
    "alias_map": f"{_e}, o AS (SELECT lower(alias) AS a, min(entity_id) AS e FROM v_aliases GROUP BY 1 HAVING count(DISTINCT entity_id) = 1) SELECT id, CASE WHEN id % 50 = 0 THEN 1 ELSE e END AS entity_id FROM v_mentions LEFT JOIN o ON lower(name) = a WHERE id % 50 = 0 OR e IS NOT NULL",
    "entity_list": f"{_e}, m AS (SELECT entity_id, count(DISTINCT id) AS mapped FROM v_mentions GROUP BY 1) SELECT e.*, coalesce(mapped, 0) AS mapped FROM v_entities e LEFT JOIN m USING (entity_id) ORDER BY mentions DESC, entity_id LIMIT 300",
    "assemble_entities": """WITH p AS (SELECT p_partkey AS seq, p_name AS name, p_brand AS canonical, p_size::BIGINT AS mentions, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS type FROM part WHERE p_partkey % 10 <> 0),
e AS (SELECT seq, name, canonical AS part, mentions // CASE WHEN seq % 7 = 0 THEN 2 ELSE 1 END AS share, coalesce(type, CASE WHEN seq % 7 = 0 THEN 'person' ELSE 'topic' END) AS type FROM p
  UNION ALL SELECT seq, name, ' ' || lower(canonical) || '  x ', mentions // 2, coalesce(type, 'person') FROM p WHERE seq % 7 = 0)
SELECT lower(regexp_replace(trim(part), '\\s+', ' ', 'g')) AS key, max_by(part, seq) AS canonical, max_by(type, seq) AS type, sum(share)::BIGINT AS mentions, count(DISTINCT name)::INTEGER AS n_aliases FROM e GROUP BY 1""",
    "near_duplicates": f"{_e} SELECT x.entity_id AS a, y.entity_id AS b FROM v_entities x JOIN v_entities y ON x.entity_id < y.entity_id AND (contains(lower(x.canonical), lower(y.canonical)) OR contains(lower(y.canonical), lower(x.canonical))) AND abs(length(x.canonical) - length(y.canonical)) <= 8",
    "resolution_worksheet": f"""{_e}, t AS (SELECT lower(name) AS name, count(*) AS n FROM v_mentions GROUP BY 1 ORDER BY n DESC, name LIMIT 350), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, name)::INTEGER AS rank FROM t),
f AS (SELECT lower(name) AS name, lower(substr(context, 1, 50)) AS s, min(id) AS id, min_by(substr(context, 1, 180), id) AS c FROM v_mentions GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM f)
SELECT k.name, k.n, k.rank, CASE WHEN k.rank <= 180 THEN 1 ELSE 2 END AS tier, ((k.rank - 1) // 20)::INTEGER AS batch, (SELECT string_agg(c, '|' ORDER BY r) FROM o WHERE o.name = k.name AND r <= 12) AS contexts FROM k""",
    "typing_guard": f"""{_e}, {_G}, wanted AS (SELECT src, dst FROM v_edges), {_P}, fam AS (SELECT src, dst, bool_or(contains(rationale, 'Sister')) AS said FROM v_pack GROUP BY 1, 2),
tx AS (SELECT t.src, t.dst, CASE WHEN t.src % 2 = 0 THEN 'works-for' WHEN t.dst % 2 = 0 THEN 'family-of' ELSE 'uses' END AS rel, CASE WHEN t.dst % 5 = 0 THEN 'backward' ELSE 'forward' END AS dir, a.type AS st, b.type AS dt, coalesce(said, false) AS said
  FROM v_edges t JOIN v_entities a ON a.entity_id = t.src JOIN v_entities b ON b.entity_id = t.dst LEFT JOIN fam USING (src, dst)),
tj AS (SELECT *, CASE rel WHEN 'family-of' THEN NOT (st = 'person' AND dt = 'person' AND said) WHEN 'works-for' THEN NOT (CASE WHEN dir = 'backward' THEN dt ELSE st END = 'person' AND CASE WHEN dir = 'backward' THEN st ELSE dt END = 'org') ELSE false END AS bad FROM tx)
SELECT src, dst, CASE WHEN bad THEN CASE WHEN st = 'person' AND dt = 'person' THEN 'discussed-with' ELSE 'related-to' END ELSE rel END AS relation, CASE WHEN bad THEN 'undirected' ELSE dir END AS direction, bad AS downgraded FROM tj""",
    "set_edge_types": f"{_e}, {_G}, {_T} SELECT src, dst, verified_relation, direction, temporality, as_of, verified, strftime(verified_at, '%Y-%m-%d %H:%M:%S') AS verified_at FROM v_typed",
    "typing_status": f"""{_e}, {_G}, {_T}, c AS (SELECT count(*) FILTER (weight >= 2) AS total, count(*) FILTER (weight >= 2 AND verified) AS typed, count(*) FILTER (verified AND verified_at >= TIMESTAMP '2024-02-01 11:55:00') AS n FROM v_typed)
SELECT total, typed, total - typed AS remaining, CASE WHEN total > 0 THEN round(100.0::DOUBLE * typed / total, 1) ELSE 0 END AS pct, round(n / 300.0::DOUBLE, 3) AS rate_per_s, CASE WHEN n > 0 THEN floor((total - typed) * 300.0::DOUBLE / n)::BIGINT END AS eta_seconds FROM c""",
    "edge_sentences": f"{_e}, {_G}, {_T} SELECT src, dst, {_W} AS sentence FROM v_typed",
    "graph_feed_d0": f"{_e}, {_G}, {_T}, {_L} SELECT * FROM links",
    "graph_feed_d1": f"{_e}, {_G}, {_T}, {_L} SELECT entity_id, id, rank, label, kind FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY id)::INTEGER AS rank, substr(name, 1, 48) AS label, kind FROM v_mentions WHERE entity_id IN (SELECT entity_id FROM nodes)) WHERE rank <= 4",
    "graph_feed_d2": f"{_e}, {_G}, {_T}, {_L}, a AS (SELECT DISTINCT c.entity_id, s.id, substr(s.statement, 1, 80) AS label, s.type AS kind FROM ch c JOIN v_assertions s USING (conv_key, chunk_idx) WHERE c.entity_id IN (SELECT entity_id FROM nodes)) SELECT * FROM (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY id)::INTEGER AS rank, label, kind FROM a) WHERE rank <= 4",
    "list_themes": f"{_e}, {_S} SELECT label, size FROM sz JOIN lb USING (type)",
    "theme_members": f"{_e}, {_S} SELECT r::INTEGER AS rank, canonical FROM rk WHERE r <= 8 AND type IN (SELECT type FROM sz)",
    "theme_of": f"{_e}, {_S} SELECT e.entity_id, label, size FROM v_entities e JOIN sz USING (type) JOIN lb USING (type) WHERE e.entity_id = 7",
}
