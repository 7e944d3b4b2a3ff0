import time

from pyspark.sql import functions as F

from lattica.sources.sinks import TableSink
from lattica.streaming import machines

POINTER = "u string, action string, x double, y double, t double, seq long"


def outcomes(spark, rows):
    df = spark.createDataFrame([("u", *r, i) for i, r in enumerate(rows)], POINTER)
    return [r["outcome"] for r in machines.folded(df, "u", machines.taps()).orderBy("t").collect()]


def tap(t, x=0.0):
    return [("down", x, 0.0, t), ("up", x, 0.0, t + 50)]


def test_taps(spark):
    assert outcomes(spark, tap(0.0)) == ["tap"]
    assert outcomes(spark, tap(0.0) + tap(200.0)) == ["tap", "double"]
    assert outcomes(spark, tap(0.0) + tap(200.0) + tap(400.0)) == ["tap", "double", "tap"]
    assert outcomes(spark, tap(0.0) + tap(200.0, 17.0)) == ["tap", "tap"]
    assert outcomes(spark, [("down", 0.0, 0.0, 0.0), ("move", 8.0, 0.0, 10.0), ("up", 8.0, 0.0, 20.0)]) == ["tap"]
    assert outcomes(spark, [("down", 0.0, 0.0, 0.0), ("move", 9.0, 0.0, 10.0), ("up", 9.0, 0.0, 20.0)]) == ["drag", "drag"]
    assert outcomes(spark, [("down", 0.0, 0.0, 0.0), ("up", 0.0, 0.0, 501.0)]) == []
    assert outcomes(spark, [("down", 0.0, 0.0, 0.0), ("cancel", 0.0, 0.0, 5.0), ("up", 0.0, 0.0, 9.0)]) == []


def test_throttle_and_cursor(spark):
    rows = [("u", float(t), i, "a" if t < 60 else "b") for i, t in enumerate(range(0, 105, 5))]
    df = spark.createDataFrame(rows, "u string, t double, seq long, value string")
    assert [r["t"] for r in machines.folded(df, "u", machines.throttle()).orderBy("t").collect()] == [0, 25, 50, 75, 100]
    assert [r["value"] for r in machines.folded(df, "u", machines.cursor()).orderBy("t").collect()] == ["a", "b"]


def test_overlay():
    m = machines.overlay("panel")
    state, out = m.step(m.start, type("E", (), {"event": "esc"}))
    assert out == ("preview", False)
    state, out = m.step(state, type("E", (), {"event": "tap"}))
    assert out == ("active", True)
    state, out = m.step(state, type("E", (), {"event": "tap"}))
    assert out == ("active", False)
    assert m.step(state, type("E", (), {"event": "viewport-exit"}))[1] == ("preview", True)
    full = machines.overlay("atlas")
    assert full.step(full.start, type("E", (), {"event": "esc"}))[1] == ("active", False)


def test_settle_fires_once():
    m = machines.settle()
    event = lambda **k: type("E", (), k)
    state, out = m.step(m.start, event(is_sim=True, moving=True, elapsed=100))
    assert out == (False, False, False)
    state, out = m.step(state, event(is_sim=True, moving=True, elapsed=8000))
    assert out == (True, True, False)
    state, out = m.step(state, event(is_sim=True, moving=True, elapsed=9000))
    assert out == (False, False, False)
    assert m.step(state, event(is_sim=True, moving=False, elapsed=9100))[1] == (True, False, True)
    assert m.step(m.start, event(is_sim=False, moving=False, elapsed=1))[1] == (False, True, True)


def test_quiescence(spark):
    rows = [("k", float(i), float(i) if i < 3 else 3.0, 0.0) for i in range(20)]
    found = machines.still_runs(spark.createDataFrame(rows, "k string, t double, x double, y double"), "k").orderBy("t").collect()
    m, state, by_fold = machines.quiescence(), machines.quiescence().start, []
    for r in found:
        state, out = m.step(state, type("E", (), {"reheat": False, "moved": r["moved"]}))
        by_fold.append(out[0])
    assert [r["moving"] for r in found] == by_fold and by_fold.index(False) == 13


def test_tracer(spark):
    rows = [("u", "begin", "a", 0.0, 0), ("u", "begin", "b", 1.0, 1), ("u", "end", "a", 5.0, 2), ("u", "end", "c", 6.0, 3), ("u", "end", "b", 9.0, 4)]
    found = machines.folded(spark.createDataFrame(rows, "u string, action string, phase string, t double, seq long"), "u", machines.tracer()).orderBy("t").collect()
    assert [(r["phase"], r["ms"]) for r in found] == [("a", 5), ("b", 8)]


def test_stream_equals_fold(spark, tmp_path):
    rows = [("u" if i % 3 else "v", float(i * 7), i, i * 7) for i in range(60)]
    df = spark.createDataFrame(rows, "u string, t double, seq long, ms long").withColumn("ts", F.timestamp_millis(F.col("ms") + 86_400_000)).drop("ms")
    for k in range(3):
        df.where(f"seq >= {k * 20} and seq < {k * 20 + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    out = machines.streamed(stream, "u", machines.throttle())
    q = out.writeStream.format("memory").queryName("emitted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("emitted").select("u", "t").collect())) == sorted(map(tuple, machines.folded(df, "u", machines.throttle()).select("u", "t").collect()))


def test_stream_sink(spark, tmp_path):
    rows = [("node", False, "a", 1.0, 1.0, None, None), ("node", False, "b", 2.0, 2.0, None, None), ("edge", False, "e", None, None, "a", "b")]
    spark.createDataFrame(rows, "kind string, removed boolean, id string, x double, y double, source string, target string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    sink = TableSink(spark, {"disable_telemetry": True})
    q = machines.sink_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert sink.nodes().count() == 2 and sink.edges().count() == 1
