from memloom.operators.tables import new_path
from memloom.streaming import tail_source
from memloom.streaming.runner import StreamRunner


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_a_failing_source_holds_up_no_other(spark, tmp_path):
    clock, calls = Clock(), {"bad": 0}
    for i in range(2):
        spark.createDataFrame([(i, "x")], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))

    def good(full):
        stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
        return tail_source.append_stream(stream, lambda s: s, str(tmp_path / "out"), str(tmp_path / "cp"))

    def bad(full):
        calls["bad"] += 1
        if calls["bad"] <= 3:
            raise ValueError("no answer")
        return 7

    def breaks(full):
        stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(lambda rows, n: 1 // 0).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()

    runner = StreamRunner(spark, new_path(spark, "events"), clock=clock, sleep=clock.sleep)
    runner.add("good", good, 5).add("bad", bad, 5).add("breaks", breaks, 5, None).run(7)
    rows = [tuple(r) for r in runner.events().orderBy("at", "source").collect()]
    of = lambda name, *events: [(r[0], r[2], r[4]) for r in rows if r[1] == name and r[2] in events]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    # polls every five seconds, the first one a full pass; failures wait 1, 2, 4 seconds
    assert of("good", "poll", "sweep")[:2] == [(0.0, "sweep", 2), (5.0, "poll", 0)]
    assert of("bad", "failed", "sweep", "poll")[:4] == [(0.0, "failed", None), (1.0, "failed", None), (3.0, "failed", None), (7.0, "sweep", 7)]
    assert sum(n for _, _, n in of("good", "batch")) == 2
    assert {r[2] for r in rows if r[1] == "breaks"} >= {"started", "terminated", "failed"} and any("ZeroDivision" in (r[5] or "") for r in rows if r[1] == "breaks")


def test_sweeps_and_stop(spark):
    clock, seen = Clock(), []
    runner = StreamRunner(spark, new_path(spark, "events"), clock=clock, sleep=clock.sleep)

    def source(full):
        seen.append((clock.now, full))
        if clock.now >= 60:
            runner.stop()

    runner.add("one", source, 5, 30).run()
    assert [t for t, _ in seen] == [5.0 * i for i in range(13)] and [t for t, full in seen if full] == [0.0, 30.0, 60.0]
