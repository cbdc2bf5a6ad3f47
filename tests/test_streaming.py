import json
import os
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import upsert_log
from memloom.operators.search import word_embedder
from memloom.operators.store import newest_wins
from memloom.sources.records import session_records
from memloom.streaming import tail_source as ts


def run(spark, root, out, checkpoint):
    q = ts.append_stream(ts.tail(spark, root), lambda s: s, out, checkpoint)
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r.session, r.at, r.value) for r in spark.read.parquet(out).collect())


def test_tailing_growing_and_replaced_files(spark, tmp_path):
    root, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    log = root / "p" / "s.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text('{"n": 1}\n{"n": 2}\n{"n": 3')
    assert [v for *_, v in run(spark, str(root), out, checkpoint)] == ['{"n": 1}', '{"n": 2}']
    with log.open("a") as f:
        f.write('0}\n')
    (root / "p" / "t.jsonl").write_text('{"n": 9}\n')
    assert [v for *_, v in run(spark, str(root), out, checkpoint)] == ['{"n": 1}', '{"n": 2}', '{"n": 30}', '{"n": 9}']
    log.unlink()
    log.write_text('{"n": 7}\n')
    assert len(run(spark, str(root), out, checkpoint)) == 5
    assert len(run(spark, str(root), out, checkpoint)) == 5


def test_pieces_of_bounded_size(tmp_path):
    log = tmp_path / "p" / "s.jsonl"
    log.parent.mkdir()
    rows = [{"n": i, "x": "y" * (i % 13)} for i in range(100)] + [{"n": 100, "x": "long" * 5000}, {"n": 101}]
    log.write_text("".join(json.dumps(r) + "\n" for r in rows))
    for size in (1, 7, 64, 300, 10**6):
        reader = ts.TailReader({"root": str(tmp_path), "max_bytes": str(size)})
        pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [x for p in pieces[: 10**5] for x in reader.read(p)]
        assert [json.loads(v)["n"] for *_, v in got] == list(range(102)), size
        assert len({x[3] for x in got}) == 102
    reader = ts.TailReader({"root": str(tmp_path), "max_bytes": "300"})
    offset = reader.latestOffset()
    with log.open("a") as f:
        f.write('{"n": 102')
    assert reader.latestOffset() == offset
    os.truncate(log, len(json.dumps(rows[0])) + 1)
    pieces = reader.partitions(offset, reader.latestOffset())
    assert [json.loads(x[4])["n"] for p in pieces for x in reader.read(p)] == [0]


def versions(spark, seed, n=60):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.1 else f"2024-01-{rng.randint(1, 9):02d}"
    rows = [(f"k{rng.randrange(5)}", i, when(), f"c{i}", f"t{i}", rng.random() < 0.05) for i in range(n)]
    return spark.createDataFrame(rows, "key string, seq long, updated_at string, created_at string, title string, forced boolean")


def plain(df):
    return sorted(map(repr, df.select("key", "seq", "updated_at", "created_at", "title").collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_deciding_versions_decide_like_all(spark, seed):
    """Whatever part of the versions is reduced, before or after the others arrive, the same version survives."""
    rows = versions(spark, seed)
    want = plain(newest_wins(rows, force="forced"))
    for test in ("seq < 30", "seq >= 30", "seq % 3 = 1", "true"):
        kept = upsert_log.deciding(rows.filter(test), force="forced")
        assert plain(newest_wins(kept.unionByName(rows.filter(f"not ({test})")), force="forced")) == want, test
        assert kept.count() <= rows.filter(test).count()
    assert upsert_log.deciding(rows, force="forced").count() < 40


def test_log_in_any_order_with_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert_log, "FANOUT", 3)
    rows = versions(spark, 7, 200)
    log = upsert_log.UpsertLog(spark, str(tmp_path / "log"), "forced")
    assert log.table() is None
    written = []
    for n, part in enumerate([5, 2, 7, 0, 1, 6, 4, 3]):
        batch = rows.filter(f"seq % 8 = {part}")
        assert log.append(batch, "s", n) and not log.append(batch, "s", n)
        written.append(batch.count())
    assert log.append(rows.limit(0), "s", 8)
    want = plain(newest_wins(rows, force="forced"))
    assert plain(log.table()) == want
    runs = log.manifest.read()[1]["runs"]
    assert {r["tier"] for r in runs} == {0, 1} and len(runs) == 4
    # a merged run holds less than its parts, and an appended one just its batch
    assert all(r["rows"] < sum(written[:3]) for r in runs if r["tier"]) and [r["rows"] for r in runs if not r["tier"]] == written[-2:]
    assert plain(log.lookup(["k1", "k4"])) == [x for x in want if "'k1'" in x or "'k4'" in x]
    assert log.lookup(["zz"]).count() == 0
    # six merged runs and an empty one
    assert log.vacuum() == 7 and plain(log.table()) == want


def test_stream_is_batch(spark, tmp_path):
    frame = versions(spark, 11)
    for k in range(2):
        frame.filter(f"seq % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        ts.upsert_stream(stream, str(tmp_path / "silver"), str(tmp_path / "cp"), force="forced").awaitTermination(120)
    assert plain(upsert_log.UpsertLog(spark, str(tmp_path / "silver"), "forced").table()) == plain(newest_wins(frame, force="forced"))


def turn(i, **more):
    return json.dumps({"type": "user", "uuid": str(i), "timestamp": f"t{i}", "message": {"role": "user", "content": f"x{i}"}} | more) + "\n"


def test_sessions_are_emitted_whole(spark, tmp_path):
    log = tmp_path / "logs" / "p" / "s.jsonl"
    log.parent.mkdir(parents=True)
    seen, fail = [], []

    def deliver(records, _):
        found = [[m.native_id for m in x.messages] for x in records.collect()]
        if fail and found:
            fail.clear()
            raise ValueError("not delivered")
        seen.extend(found)

    def go():
        q = ts.session_stream(ts.tail(spark, str(tmp_path / "logs")), deliver, str(tmp_path / "cp"))
        q.awaitTermination(120)

    def say(text, mode="a"):
        with log.open(mode) as f:
            f.write(text)

    say(turn(1) + turn(2))
    go()
    assert seen == [["1", "2"]]
    say(json.dumps({"type": "progress"}) + "\n" + turn(3, isSidechain=True) + turn(2) + "{broken\n" + turn(9, message={"content": "[]"}))
    go()
    assert seen == [["1", "2"]]  # nothing that counts has come
    say(turn(3) + turn(None, uuid=None))
    fail.append(True)
    with pytest.raises(Exception, match="not delivered"):
        go()
    go()  # the batch is repeated
    assert seen == [["1", "2"], ["1", "2", "3", None]]
    log.unlink()
    say(turn(7) + turn(8), "w")
    go()
    assert seen[-1] == ["7", "8"] and len(seen) == 3  # a log that began anew


def test_messages_are_told_like_the_records(spark):
    lines = [turn(i, **more) for i, more in enumerate([{}, {"type": "assistant"}, {"type": "system"}, {"isSidechain": True}, {"isSidechain": None}, {"message": None}, {"message": {"content": []}}, {"message": {"content": [{"type": "text", "text": "a"}]}}, {"message": {"content": ["a"]}}, {"message": {"content": "[1]"}}, {"message": {"content": "[no json"}}, {"message": {"content": ""}}, {"message": {"content": 5}}, {"uuid": ""}])] + ["{", "[]", "7", ""]
    rows = spark.createDataFrame([("p", f"s{i}", 0, 1, x.rstrip("\n")) for i, x in enumerate(lines)], "project string, session string, block long, at long, value string")
    want = {r.key.split(":s")[1] for r in session_records(rows).collect()}
    assert {str(i) for i, x in enumerate(lines) if ts.message_id(x) is not None} == want


def test_first_text_of_a_key_is_embedded(spark, tmp_path):
    rows = [("a", "one two"), ("b", None), ("a", "other words")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "k string, text string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, text string").parquet(str(tmp_path / "in"))
        ts.embed_stream(stream, ["k"], word_embedder(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.k: r.embedding for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = spark.createDataFrame(rows[:1], "k string, text string").select(word_embedder()(F.col("text")).alias("e")).first().e
    assert got == {"a": want, "b": [0.0] * 16} and abs(sum(x * x for x in want) - 1) < 1e-9
