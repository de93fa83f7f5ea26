"""Streams against their batch twins."""

from draftlake.operators.rows import task_states
from draftlake.plans.fixtures import frame
from draftlake.sources.stores import ChunkIndex
from draftlake.streaming import tasks

DATA = "/root/testdata/sf0.001"


def source(spark, tmp_path, df, name):
    path = str(tmp_path / name)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_states_equal_batch(spark, tmp_path):
    log = frame(spark, DATA, "task_log")
    q = tasks.task_state_stream(source(spark, tmp_path, log, "log")).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, task_states(log).collect()))


def test_nothing_follows_an_end(spark, tmp_path):
    log = spark.createDataFrame([(1, "START", 1, 0.0), (1, "FINISH", 2, 0.0), (1, "PROGRESS", 3, 5.0), (2, "PROGRESS", 1, 1.0)], "task_id long, kind string, s long, value double")
    log = tasks.with_event_time(log, "s").select("task_id", "kind", "ts", "value").coalesce(1)
    path = str(tmp_path / "log")
    log.write.parquet(path)
    q = tasks.legal_transitions(spark.readStream.schema(log.schema).parquet(path)).writeStream.format("memory").queryName("legal").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = {(r["task_id"], r["kind"]): (r["status"], r["legal"]) for r in spark.table("legal").collect()}
    assert rows == {(1, "START"): ("RUNNING", True), (1, "FINISH"): ("SUCCESS", True), (1, "PROGRESS"): ("SUCCESS", False), (2, "PROGRESS"): ("RUNNING", True)}


def test_transitions_over_a_restart(spark, tmp_path):
    path, cp, out = str(tmp_path / "log"), str(tmp_path / "cp"), str(tmp_path / "out")

    def send(*rows):
        log = spark.createDataFrame(list(rows), "task_id long, kind string, s long")
        tasks.with_event_time(log, "s").select("task_id", "kind", "ts").coalesce(1).write.mode("append").parquet(path)
        stream = tasks.legal_transitions(spark.readStream.schema("task_id long, kind string, ts timestamp").parquet(path))
        stream.writeStream.format("parquet").option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return {(r["task_id"], r["kind"], int(r["ts"].timestamp())): (r["status"], r["legal"]) for r in spark.read.parquet(out).collect()}

    send((1, "START", 1000), (2, "START", 1000))
    got = send((1, "FINISH", 1100), (2, "PROGRESS", 1100))
    assert got[1, "FINISH", 1100] == ("SUCCESS", True) and got[2, "PROGRESS", 1100] == ("RUNNING", True)
    got = send((1, "START", 1200), (2, "FAIL", 1200), (3, "FAIL", 1200))
    assert got[1, "START", 1200] == ("SUCCESS", False) and got[2, "FAIL", 1200] == ("FAILURE", True) and got[3, "FAIL", 1200] == ("FAILURE", True)
    # Two days on, the timers have dropped what was known of task 1.
    send((9, "START", 1200 + 2 * 86_400))
    got = send((9, "PROGRESS", 1300 + 2 * 86_400))
    got = send((1, "START", 1400 + 2 * 86_400))
    assert got[1, "START", 1400 + 2 * 86_400] == ("RUNNING", True)


def test_files_once_and_index(spark, tmp_path):
    files = tasks.with_event_time(spark.createDataFrame([("a", "s1", 1), ("a", "s1", 2), ("b", "s2", 3)], "identity string, source string, s long"), "s").select("identity", "source", "ts")
    q = tasks.new_files(source(spark, tmp_path, files, "files")).writeStream.format("memory").queryName("files").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["identity"] for r in spark.table("files").collect()) == ["a", "b"]
    chunks = spark.createDataFrame([("s1", "x")], "source string, chunk string")
    path = str(tmp_path / "chunks")
    chunks.write.parquet(path)
    index = ChunkIndex(spark, str(tmp_path / "index"), "source string, chunk string")
    q = tasks.keep_index(spark.readStream.schema(chunks.schema).parquet(path), index).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([("s1", "y"), ("s2", "z")], "source string, chunk string").write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, index.read().collect())) == [("s1", "y"), ("s2", "z")]
