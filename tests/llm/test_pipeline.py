import hashlib
import random

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm.common import materialize
from memloom.llm import decontaminate, language, lines, mixing
from tests.llm import test_decontaminate, test_jaccard, test_lines


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert docs.count() <= before
    listed = [x.line for x in lines.split_lines(docs).collect()]
    assert len(listed) == len(set(listed))
    index = next(decontaminate.blocks(spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert not any(decontaminate.search(r.text, index) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert all(0 < r.taken <= 3 * r.size for r in last)


def test_run_on_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "the cat and the dog", "en", "a", 19), (4, "the cat and the dog", "en", "b", 19), (None, "le chien et le chat", "fr", "b", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_id", "_row", "_spans", "_removed", "lang_pred", "score", "fp", "size", "a.b", "at"):
        docs = docs.withColumn(name, F.lit("2024-01-01").cast("timestamp") if name == "at" else F.lit(7))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "something else that is never found")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, names = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.materialize(stage(spark, table, str(tmp_path)), name)
        assert table.columns == names
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {3, None}
    assert 3 in {r.doc_id for r in got}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's whole result on a table with copies, near lines, benchmark passages, null ids and odd texts."""
    rng = random.Random(12)
    words = {"en": "the and of house with man that cat dog thing red big".split(), "de": "der und das haus mit einem mann auf strasse hund rot gross".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(("", "", "s")) for _ in range(n))
    item = "this passage of the benchmark is found wherever it stands in a text"
    rows = []
    for d in range(60):
        lang = rng.choice(("en", "de"))
        rows.append((d, "\n".join(say(lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))), lang, rng.choice("abc")))
    for d in range(60, 90):
        _, text, lang, source = rows[rng.randrange(60)]
        kind = d % 4
        text = text if kind == 0 else text + " x" if kind == 1 else f"{text}\n{item}" if kind == 2 else text[:-1]
        rows.append((d if d % 7 else None, text, lang, source))
    rows += [(None, None, None, None), (91, "", "en", "a"), (92, "12 !", "en", "a"), (5, "another text under the id of five with the cat", "en", "b"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = corpus_pipeline.materialize(docs, "docs")
    show = lambda rows: sorted(repr(tuple(r)[:2]) for r in rows)

    model = language.train(docs)
    texts = [r.text for r in docs.collect()]
    langs, scores, _ = language.predict(texts, model, language.letter_table())
    want = [r for r, lang, score in zip(docs.collect(), langs, scores, strict=True) if lang != "und" and score > 0.5]
    docs = corpus_pipeline.materialize(corpus_pipeline.identify_language(spark, docs, str(tmp_path)), "language")
    assert show(docs.collect()) == show(want)

    before = [(r.doc_id, r.text) for r in docs.collect()]
    gone = test_lines.brute(before, lines.BUDGETS)
    left = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g), g) for (d, t), g in zip(before, gone, strict=True)]
    docs = corpus_pipeline.materialize(corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)), "lines")
    assert show(docs.collect()) == show([(d, t) for d, t, g in left if not g or t.split()])
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    before = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    sets = [test_jaccard.naive_set(t) for _, t in before]
    group = list(range(len(before)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    docs = corpus_pipeline.materialize(corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)), "near")
    assert show(docs.collect()) == show([next(r for r, g in zip(before, group, strict=True) if g == k) for k in set(group)])

    before = docs.collect()
    docs = corpus_pipeline.materialize(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)), "clean")
    assert show(docs.collect()) == show([r for r in before if not test_decontaminate.want_of([(1, item)], r.text or "")])

    got = corpus_pipeline.mix(spark, docs, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect()
    docs.toPandas().to_parquet(tmp_path / "last.parquet")
    want = duckdb.sql(mixing.ORACLE.format(docs=f"'{tmp_path}/last.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in want if r[-1])


def test_two_runs_side_by_side(spark):
    """Stages of two threads leave each other's tables alone."""
    import threading

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.dedup_lines(spark, docs, ""), "").count()
    got = {}

    def run(name, pause):
        out = materialize(corpus_pipeline.dedup_lines(spark, docs, ""), "lines")
        barrier.wait(300)
        pause and got.setdefault("between", corpus_pipeline.drop_near_copies(spark, docs.limit(5), "").count())
        barrier.wait(300)
        got[name] = corpus_pipeline.drop_near_copies(spark, out, "").count()

    barrier = threading.Barrier(2)
    threads = [threading.Thread(target=run, args=x) for x in (("a", False), ("b", True))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(600)
    assert got.pop("between") >= 1 and got == {"a": want, "b": want}
