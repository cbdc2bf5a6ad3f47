import json
import os
import random

import pytest

from memloom.streaming import tail_files, tail_source


def lines(job):
    return sorted((r.session, r.at, r.value) for r in job.landed().collect())


def test_growing_truncated_and_replaced_files(spark, tmp_path):
    root = tmp_path / "logs"
    log = root / "p" / "s.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text('{"n": 1}\n{"n": 2}\n{"n": 3')
    (root / "p" / "other.txt").write_text("no log\n")
    job = tail_files.TailJob(spark, str(root), str(tmp_path / "state"))
    assert job.poll() == 18 and job.poll() == 0
    with log.open("a") as f:
        f.write("0}\n")
    (root / "q").mkdir()
    (root / "q" / "t.jsonl").write_text("é\n\n")
    assert job.catch_up() == 1
    want = [("s", 0, '{"n": 1}'), ("s", 9, '{"n": 2}'), ("s", 18, '{"n": 30}'), ("t", 0, "é"), ("t", 3, "")]
    assert lines(job) == want
    log.write_text('{"m": 9}\n')  # shorter
    os.utime(log, (2_000_000_000, 2_000_000_000))
    assert job.catch_up() == 1
    (root / "q" / "t.jsonl").write_text("ab\n\n")  # another one, as long as the one before
    os.utime(root / "q" / "t.jsonl", (2_000_000_001, 2_000_000_001))
    assert job.catch_up() == 1
    (root / "q" / "t.jsonl").unlink()
    assert job.catch_up() == 0
    assert lines(job) == sorted([*want, ("s", 0, '{"m": 9}'), ("t", 0, "ab"), ("t", 3, "")])


@pytest.mark.parametrize(("max_bytes", "piece"), [(50, 7), (300, 64), (10**6, 11)])
def test_batches_and_pieces_of_bounded_size(spark, tmp_path, max_bytes, piece):
    rng, want = random.Random(2), []
    for s in range(3):
        path = tmp_path / "logs" / "p" / f"s{s}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = ["x" * rng.randint(0, 30) for _ in range(12)] + (["long" * 60] if s == 1 else [])
        path.write_text("".join(r + "\n" for r in rows) + ("open end" if s == 2 else ""))
        at = 0
        for r in rows:
            want.append((f"s{s}", at, r))
            at += len(r) + 1
    job = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state"), max_bytes, piece)
    sizes = []
    while size := job.poll():
        sizes.append(size)
        assert len(sizes) < 60
    assert lines(job) == sorted(want)
    # a single line may be longer than a batch
    assert max(sizes) <= max(max_bytes, 30 + 1 + 241) and sum(sizes) == sum(len(x) + 1 for _, _, x in want)


def test_a_killed_poll_goes_on_by_its_plan(spark, tmp_path, monkeypatch):
    log = tmp_path / "logs" / "p" / "s.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text("one\n")
    job = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state"))

    def lost(*_):
        raise RuntimeError("lost")

    for name, target in (("_read", job), ("append", job.cursors), ("write", job.manifest)):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(target, name, lost)
            job.poll()
        with log.open("a") as f:
            f.write(f"{name}\n")
    again = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state"))
    again.catch_up()
    assert [x for _, _, x in lines(again)] == ["one", "_read", "append", "write"]


def test_what_is_kept_does_not_follow_the_files(spark, tmp_path):
    root = tmp_path / "logs" / "p"
    root.mkdir(parents=True)
    for i in range(40):
        (root / f"s{i}.jsonl").write_text(f"{i}\n")
    job = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state"))
    job.catch_up()
    with (root / "s7.jsonl").open("a") as f:
        f.write("more\n")
    job.poll()
    plan = spark.read.parquet(f"{job.state}/plans/{job.manifest.read()[1]['batch'] - 1}").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.first) for r in plan] == [("s7.jsonl", 2)]
    assert len(json.dumps(job.manifest.read()[1])) < 40


def test_sessions_from_files(spark, tmp_path):
    log = tmp_path / "logs" / "p" / "s.jsonl"
    log.parent.mkdir(parents=True)
    say = lambda i: json.dumps({"type": "user", "uuid": str(i), "timestamp": f"t{i}", "message": {"role": "user", "content": f"x{i}"}}) + "\n"
    job, seen = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state")), []
    for text in (say(1) + say(2), json.dumps({"type": "note"}) + "\n", say(3)):
        with log.open("a") as f:
            f.write(text)
        job.catch_up()
        tail_source.session_stream(job.stream(), lambda r, _: seen.extend([m.native_id for m in x.messages] for x in r.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [["1", "2"], ["1", "2", "3"]]


def test_cursors_are_not_sent_through_the_driver(spark, tmp_path):
    """A plan after the first poll joins the listing and the cursors without a broadcast."""
    for n in range(5):
        (tmp_path / "in" / "p").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "p" / f"s{n}.jsonl").write_text("a\n")
    job = tail_files.TailJob(spark, str(tmp_path / "in"), str(tmp_path / "state"))
    assert job.poll() == 10
    (tmp_path / "in" / "p" / "s3.jsonl").write_text("a\nbb\n")
    plan = job._plan()
    assert [(r.first, r.stop) for r in plan.collect()] == [(2, 5)]
    ran = plan._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran


def test_listing_is_that_of_spark_without_its_file_index(spark, tmp_path, monkeypatch):
    """The same files, lengths and times as Spark's file source lists, which keeps the status of every file in the driver."""
    root = tmp_path / "logs"
    names = ["p/s.jsonl", "p/t.jsonl", "p/empty.jsonl", "p/.hidden.jsonl", "p/_hidden.jsonl", "p/other.txt", "p/a b%20é[1].jsonl", "p/deep/x.jsonl", "-home-me/s.jsonl", ".dot/s.jsonl", "_low/s.jsonl", "odd.jsonl/s.jsonl", "top.jsonl", "top.txt"]
    for i, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "empty" in name else f"{i}\n" * (i + 1))
        os.utime(path, ns=(0, 1_700_000_000_123_456_789 + i * 10**9))
    (root / "none").mkdir()
    (root / "p" / "broken.jsonl").symlink_to(root / "nowhere.jsonl")
    (root / "linked").symlink_to(root / "p")
    for k in range(50):
        (root / "many").mkdir(exist_ok=True)
        (root / "many" / f"s{k}.jsonl").write_text("a\n")
    monkeypatch.setattr(tail_files, "LISTED_ROWS", 7)
    job = tail_files.TailJob(spark, str(root), str(tmp_path / "state"))
    listing = job.listing()
    assert listing.inputFiles() == []
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*")
    want = files.selectExpr("path", "length", "unix_micros(modificationTime) as mtime")
    assert sorted(listing.collect()) == sorted(want.collect())
    assert job.catch_up() == 1
    with pytest.raises(FileNotFoundError):
        tail_files.TailJob(spark, str(tmp_path / "nothing"), str(tmp_path / "other")).poll()


def test_a_batch_takes_any_number_of_files(spark, tmp_path, monkeypatch):
    """Files are dealt to batches by their bytes alone, in the order of their times, whatever parts the sort has."""
    root = tmp_path / "logs" / "p"
    root.mkdir(parents=True)
    for k in range(300):
        (root / f"s{k}.jsonl").write_text(f"{k:03d}\n")
        os.utime(root / f"s{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    monkeypatch.setattr(tail_files, "MOST_FILES", 20, raising=False)  # the bound that there was
    job = tail_files.TailJob(spark, str(tmp_path / "logs"), str(tmp_path / "state"), 600)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [job.poll(), job.poll(), job.poll()] == [600, 600, 0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{job.state}/grown").count() == 0
    first = {r.session for r in spark.read.parquet(f"{job.lines}/0").collect()}
    assert first == {f"s{k}" for k in range(150)} and job.landed().count() == 300
    (root / "s3.jsonl").write_text("003\nmore\n")
    grown = job._grown()
    assert [(r.path.rsplit("/", 1)[-1], r.offset, r.new) for r in grown.collect()] == [("s3.jsonl", 4, 5)]
    ran = grown._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran
