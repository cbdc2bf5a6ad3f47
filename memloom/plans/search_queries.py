"""Keyword, vector and fused search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.operators import ledger, resolve, search
from memloom.operators.tables import new_path, stored
from memloom.operators.text_index import TextIndex
from memloom.sources import views as v

TERMS = ("the", "and", "of")
KEEP = "source = 'src0'"


def docs(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", "text", "source")


def bm25(spark, sf):
    counts = stored(search.term_counts(docs(spark, sf), ["doc_id"], t.plain_tokens(F.col("text")), list(TERMS)), "counts")
    return search.bm25_scan(counts, ["doc_id"], len(TERMS)).withColumn("score", F.round("score", 6))


def bm25_postings(spark, sf):
    """The same ranking from postings, as a stored index gives it."""
    postings, stats = search.index(docs(spark, sf), ["doc_id"], t.plain_tokens(F.col("text")), list(TERMS))
    scored = search.bm25(postings, stats, list(TERMS), ["doc_id"]).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(25)


def query_vector(spark, sf, vec_id: int = 1) -> list[float]:
    row = v.table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def bm25_top(spark, sf, keep=None, k=25):
    rows = bm25(spark, sf)
    if keep is not None:
        rows = rows.join(docs(spark, sf).filter(keep).select("doc_id"), "doc_id", "left_semi")
    return rows.orderBy(F.col("score").desc(), "doc_id").limit(k)


def knn(spark, sf, **kw):
    return search.knn(v.vectors(spark, sf), query_vector(spark, sf), ["vec_id"], **kw)


def hybrid(spark, sf):
    words = bm25_top(spark, sf).withColumnRenamed("doc_id", "id")
    near = knn(spark, sf).withColumnRenamed("vec_id", "id")
    return search.rrf([words, near], [[F.col("score").desc(), F.col("id")], [F.col("sim").desc(), F.col("id")]], ["id"])


def search_messages(spark, sf):
    """Search over messages with filters on their conversations, hits with excerpts."""
    c = v.conversations(spark, sf)
    m = v.messages(spark, sf).select("conv_key", "native_id", "role", "created_at", "text")
    keep = ledger.not_excluded() & (F.col("source") != "gemini.google.com") & (F.col("created_at") >= ledger.date_bounds("2024-01-02")[0])
    hits = search.keyword_search(ledger.with_conversations(m, c), "the AND of", ["conv_key", "native_id"], t.plain_tokens(F.col("text")), 25, keep, stem=str)
    return ledger.hydrate(hits.withColumn("score", F.round("score", 6)), m, c)


def indexed(spark, sf):
    """An index of all documents, of which later a third came again with more words and a tenth went."""
    index = TextIndex(spark, new_path(spark, "index"), ["doc_id"], t.plain_tokens)
    rows = docs(spark, sf).select("doc_id", "text")
    index.add(rows)
    index.add(rows.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" the of the and thing"))))
    index.remove(rows.filter("doc_id % 10 = 3").select("doc_id"))
    return index


def index_hits(spark, sf, query, limit=25):
    return indexed(spark, sf).search(query, limit).withColumn("score", F.round("score", 6))


def index_filtered(spark, sf):
    """Hits among the documents of one source; merged, so that nothing that is gone is left."""
    index = indexed(spark, sf)
    index.merge()
    index.vacuum()
    hits = index.search("thing OR (the AND of)", 25, docs(spark, sf).filter(KEEP).select("doc_id"))
    return hits.withColumn("score", F.round("score", 6))


def splits(spark, sf):
    e = v.table(spark, sf, "embeddings")
    centre = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    centre = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    out = resolve.assign_splits(e.select(F.col("vec_id").alias("id"), "embedding"), centre.select(F.col("label").cast("string").alias("canonical"), "embedding"))
    return out.select("id", "canonical", F.round("similarity", 5).alias("similarity"))


QUERIES = {
    "bm25_topk": lambda s, d: bm25_top(s, d),
    "bm25_filtered": lambda s, d: bm25_top(s, d, KEEP),
    "bm25_postings": bm25_postings,
    "bm25_porter": lambda s, d: search.keyword_search(docs(s, d), '(the OR "and the") NOT zzz*', ["doc_id"], t.stemmed_tokens(F.col("text"))).withColumn("score", F.round("score", 6)),
    "fts_grammar": lambda s, d: search.keyword_search(docs(s, d), '"of the" OR NEAR(and was, 4)', ["doc_id"], t.plain_tokens(F.col("text")), 100, stem=str).withColumn("score", F.round("score", 6)),
    "index_topk": lambda s, d: index_hits(s, d, "the OR of OR thing"),
    "index_all_words": lambda s, d: index_hits(s, d, "the of thing"),
    "index_phrases": lambda s, d: index_hits(s, d, '"of the" OR NEAR(and was, 4)', 100),
    "index_prefix": lambda s, d: index_hits(s, d, "(thi* AND the) NOT thou"),
    "index_filtered": index_filtered,
    "search_messages": search_messages,
    "fts_syntax_error": lambda s, d: search.keyword_search(docs(s, d), "what's", ["doc_id"], t.plain_tokens(F.col("text"))),
    "knn_topk": lambda s, d: knn(s, d),
    "knn_filtered": lambda s, d: knn(s, d, keep=F.col("owner") != "sealed"),
    "knn_postfilter": lambda s, d: knn(s, d, k=5, keep=F.col("source") == "claude.ai", overfetch=4),
    "split_assignment": splits,
    "split_distribution": lambda s, d: splits(s, d).groupBy("canonical").agg(F.count("*").alias("n")),
    "hybrid_rrf": hybrid,
}

_BM25 = f"""tok AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS l FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(l) AS a FROM len),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok WHERE term IN {TERMS} GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
sc AS (SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY doc_id HAVING count(*) = {len(TERMS)})"""
_SIM = "sim AS (SELECT v.*, round(list_dot_product(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS sim FROM v_vectors v)"
_SPLITS = """WITH x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, round(avg(x), 9) AS x FROM x GROUP BY 1, 2),
m AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY 1),
p AS (SELECT e.vec_id AS id, m.label::VARCHAR AS canonical,
 round(list_dot_product(e.embedding::DOUBLE[], m.e) / ((sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product(m.e, m.e)) + 1e-9)), 9) AS s FROM embeddings e, m),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, canonical) AS r FROM p) """
#: The rows that ``indexed`` holds at the end, their words, and the scores of single words.
_INDEXED = """dd AS (SELECT doc_id, source, text || CASE WHEN doc_id % 3 = 0 THEN ' the of the and thing' ELSE '' END AS text FROM documents WHERE doc_id % 10 <> 3),
t AS (SELECT doc_id, source, coalesce(regexp_extract_all(lower(text), '[a-z]+'), []) AS w FROM dd), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM t)"""
_WORDS = f"""{_INDEXED}, x AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM x GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
part AS (SELECT doc_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / a)) AS s FROM tf JOIN df USING (term) JOIN t USING (doc_id), st)"""
_BEST = "SELECT doc_id, round(s, 6) AS score FROM r ORDER BY s DESC, doc_id LIMIT"
_vec = v.with_views("vectors")
ORACLES = {
    "index_topk": f"WITH {_WORDS}, r AS (SELECT doc_id, sum(s) AS s FROM part WHERE term IN ('the', 'of', 'thing') GROUP BY 1) {_BEST} 25",
    "index_all_words": f"WITH {_WORDS}, r AS (SELECT doc_id, sum(s) AS s FROM part WHERE term IN ('the', 'of', 'thing') GROUP BY 1 HAVING count(*) = 3) {_BEST} 25",
    "index_phrases": f"""WITH {_INDEXED},
p AS (SELECT * FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w IN ('of', 'the', 'and', 'was')),
f AS (SELECT 0 AS k, a.doc_id, count(*)::DOUBLE AS f FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.w = 'of' AND b.w = 'the' GROUP BY ALL
  UNION ALL SELECT 1, doc_id, count(*) FROM (SELECT DISTINCT a.doc_id, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 5 WHERE a.w = 'and' AND b.w = 'was') GROUP BY ALL
  UNION ALL SELECT 2, doc_id, count(*) FROM (SELECT DISTINCT a.doc_id, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 5 WHERE a.w = 'was' AND b.w = 'and') GROUP BY ALL),
d AS (SELECT k, count(*)::DOUBLE AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / a))) AS s FROM f JOIN d USING (k) JOIN t USING (doc_id), st GROUP BY doc_id) {_BEST} 100""",
    "index_prefix": f"""WITH {_INDEXED}, m AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS f1, len(list_filter(w, lambda x: starts_with(x, 'thi')))::DOUBLE AS f0, len(list_filter(w, lambda x: x = 'thou')) AS f2 FROM t),
d AS (SELECT count(*) FILTER (f0 > 0)::DOUBLE AS d0, count(*) FILTER (f1 > 0)::DOUBLE AS d1 FROM m),
r AS (SELECT doc_id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) AS s FROM m, d, st WHERE f0 > 0 AND f1 > 0 AND f2 = 0) {_BEST} 25""",
    "index_filtered": f"""WITH {_WORDS}, q AS (SELECT doc_id, sum(s) AS s, count(*) FILTER (term = 'thing') AS h, count(*) FILTER (term <> 'thing') AS o FROM part WHERE term IN ('the', 'of', 'thing') GROUP BY 1),
r AS (SELECT doc_id, s FROM q JOIN t USING (doc_id) WHERE source = 'src0' AND (h > 0 OR o = 2)) {_BEST} 25""",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 25",
    "bm25_filtered": f"WITH {_BM25} SELECT * FROM sc WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0') ORDER BY score DESC, doc_id LIMIT 25",
    "bm25_postings": f"WITH {_BM25} SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 25",
    "fts_grammar": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM t),
p AS (SELECT * FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w IN ('of', 'the', 'and', 'was')),
f AS (SELECT 0 AS k, a.doc_id, count(*)::DOUBLE AS f FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.w = 'of' AND b.w = 'the' GROUP BY ALL
  UNION ALL SELECT 1, doc_id, count(*) FROM (SELECT DISTINCT a.doc_id, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 5 WHERE a.w = 'and' AND b.w = 'was') GROUP BY ALL
  UNION ALL SELECT 2, doc_id, count(*) FROM (SELECT DISTINCT a.doc_id, a.i FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 5 WHERE a.w = 'was' AND b.w = 'and') GROUP BY ALL),
d AS (SELECT k, count(*)::DOUBLE AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / a))) AS s FROM f JOIN d USING (k) JOIN t USING (doc_id), st GROUP BY doc_id)
SELECT doc_id, round(s, 6) AS score FROM r ORDER BY s DESC, doc_id LIMIT 100""",
    "search_messages": f"""{v.with_views('messages', 'conversations')}, j AS (SELECT m.conv_key, native_id, role, m.created_at, text, c.source, c.owner, c.title, regexp_extract_all(lower(text), '[a-z]+') AS w FROM v_messages m JOIN v_conversations c USING (conv_key)),
k AS (SELECT *, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS f1, len(list_filter(w, lambda x: x = 'of'))::DOUBLE AS f2 FROM j),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM k),
r AS (SELECT k.*, greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len(w) / a)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len(w) / a)) AS s
  FROM k, st WHERE f1 > 0 AND f2 > 0 AND owner NOT IN ('sealed') AND source <> 'gemini.google.com' AND created_at >= '2024-01-02T00:00:00')
SELECT conv_key, native_id, round(s, 6) AS score, role, created_at, substr(text, 1, 300) AS excerpt, title, source FROM r ORDER BY s DESC, conv_key, native_id LIMIT 25""",
    "fts_syntax_error": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false",
    "knn_topk": f"{_vec}, {_SIM} SELECT vec_id, sim FROM sim ORDER BY sim DESC, vec_id LIMIT 25",
    "knn_filtered": f"{_vec}, {_SIM} SELECT vec_id, sim FROM sim WHERE owner <> 'sealed' ORDER BY sim DESC, vec_id LIMIT 25",
    "knn_postfilter": f"{_vec}, {_SIM} SELECT vec_id, sim FROM (SELECT * FROM sim ORDER BY sim DESC, vec_id LIMIT 20) WHERE source = 'claude.ai' ORDER BY sim DESC, vec_id LIMIT 5",
    "split_assignment": _SPLITS + "SELECT id, canonical, round(s, 5) AS similarity FROM r WHERE r = 1",
    "split_distribution": _SPLITS + "SELECT canonical, count(*) AS n FROM r WHERE r = 1 GROUP BY 1",
    "hybrid_rrf": f"""{_vec}, {_SIM}, {_BM25}, w AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, 0 AS list FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 25)),
n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS rank, 1 AS list FROM (SELECT * FROM sim ORDER BY sim DESC, vec_id LIMIT 25)),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(list * 1000 + rank) AS first, count(DISTINCT list) AS k, min(list) AS l FROM (SELECT * FROM w UNION ALL SELECT * FROM n) GROUP BY id)
SELECT id, round(s, 9) AS score, CASE WHEN k > 1 THEN 'both' WHEN l = 0 THEN 'keyword' ELSE 'semantic' END AS via FROM f ORDER BY round(s, 12) DESC, first LIMIT 8""",
}
