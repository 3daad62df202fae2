"""Stages switch in one step, logs take a batch once."""

import os
import signal
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import serving
from tidemark.sources import logs, stage


def numbers(spark, n, v=0):
    return spark.range(n).select(F.col("id").alias("key"), F.lit(v).alias("v"), F.lit(v).alias("updated_at"))


def test_a_stage_is_the_old_one_until_the_new_one_is_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError, match="s; run"):
        stage.load_stage(spark, path)
    assert stage.save_stage(numbers(spark, 5), path).count() == 5
    reader = stage.load_stage(spark, path)
    fails = numbers(spark, 50).withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        stage.save_stage(fails, path)
    assert stage.load_stage(spark, path).count() == 5
    with monkeypatch.context() as m:
        m.setattr(stage, "_switch", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            stage.save_stage(numbers(spark, 6), path)
    assert stage.load_stage(spark, path).count() == 5
    assert stage.save_stage(stage.load_stage(spark, path).filter("key < 3"), path).count() == 3  # reads what it replaces
    assert reader.count() == 5  # a reader keeps its version
    assert stage.prune(spark, path) == 3 and stage.load_stage(spark, path).count() == 3 and stage.prune(spark, path) == 0


def test_a_killed_run_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "s")
    stage.save_stage(numbers(spark, 5), path)
    code = f"""
        import sys, time
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark.sql import SparkSession
        from tidemark.sources import stage
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        def slow(batches):
            for b in batches:
                open({str(tmp_path / "began")!r}, "w").close()
                time.sleep(120)
                yield b
        stage.save_stage(s.range(0, 100, 1, 4).mapInArrow(slow, "id long"), {path!r})
    """
    run = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        for _ in range(600):
            if (tmp_path / "began").exists() or run.poll() is not None:
                break
            time.sleep(0.1)
        assert (tmp_path / "began").exists()
    finally:
        os.killpg(run.pid, signal.SIGKILL)
        run.wait()
    assert sorted(r["key"] for r in stage.load_stage(spark, path).collect()) == list(range(5))
    assert stage.save_stage(numbers(spark, 7), path).count() == 7


def test_upserts_write_only_the_buckets_they_touch(spark, tmp_path):
    path = str(tmp_path / "u")
    first = stage.upsert_stage(numbers(spark, 500), path, "key")
    assert first.count() == 500
    before = set(stage._read_pointer(spark, path)["folders"])
    new = spark.createDataFrame([(3, 9, 2), (3, 8, 1), (1000, 7, 1), (None, 5, 1)], "key long, v int, updated_at int")
    got = {r["key"]: r["v"] for r in stage.upsert_stage(new, path, "key").collect()}
    assert len(got) == 502 and got[3] == 9 and got[1000] == 7 and got[None] == 5 and got[4] == 0
    after = set(stage._read_pointer(spark, path)["folders"])
    assert len(before & after) >= len(before) - 3 and len({f.split("/")[0] for f in after - before}) == 1
    assert stage.upsert_stage(new.limit(0), path, "key").count() == 502 and set(stage._read_pointer(spark, path)["folders"]) == after
    plain = str(tmp_path / "p")
    stage.save_stage(numbers(spark, 20), plain)
    assert stage.upsert_stage(new.filter("key is not null"), plain, "key").count() == 21
    assert "_bucket" not in stage.load_stage(spark, plain).columns


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("1", "7", "retained"), ("2", "8", "churned")], "id string, retention_action_id string, outcome string")
    assert logs.read_log(spark, path, serving.FEEDBACK).count() == 0
    assert logs.append_once(rows, path, 1, serving.FEEDBACK) and not logs.append_once(rows, path, 1, serving.FEEDBACK)
    assert logs.append_once(rows.limit(1), path, "other", serving.FEEDBACK)
    got = logs.read_log(spark, path, serving.FEEDBACK)
    assert got.count() == 3 and got.columns == [*serving.FEEDBACK.names, "batch"] and got.filter("customer_id is null").count() == 3
    broken = rows.withColumn("outcome", F.when(F.col("id") == "2", F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        logs.append_once(broken, path, 2, serving.FEEDBACK)
    assert logs.read_log(spark, path, serving.FEEDBACK).count() == 3 and logs.append_once(rows, path, 2, serving.FEEDBACK)
    with pytest.raises(ValueError):
        logs.append_once(rows.withColumn("odd", F.lit(1)), path, 3, serving.FEEDBACK)
    with pytest.raises(ValueError):
        logs.append_once(rows, path, "a/b", serving.FEEDBACK)


def test_a_stream_that_starts_again_adds_nothing_twice(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.createDataFrame([(str(i), str(i % 3), "retained") for i in range(9)], "id string, retention_action_id string, outcome string")
    rows.repartition(3).write.parquet(source)
    for checkpoint in ("a", "a", "b"):  # the last has forgotten what it has done
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = logs.stream_to_log(stream, path, serving.FEEDBACK, str(tmp_path / checkpoint)).start()
        q.processAllAvailable()
        q.stop()
    assert logs.read_log(spark, path, serving.FEEDBACK).count() == 9


def test_rows_of_conversations_and_messages(spark):
    m = spark.createDataFrame([(1, "s", 0, "user", "hi", "2024-01-02 00:00:00", None), (1, "s", 1, "assistant", "ho", "2024-01-01 00:00:00", ["lookup"])], "conversation_id long, session_id string, turn int, role string, content string, created_at string, tools array<string>")
    c = serving.conversation_rows(m).collect()
    assert [(r["id"], r["session_id"], str(r["created_at"])) for r in c] == [("1", "s", "2024-01-01 00:00:00")]
    got = sorted(map(tuple, serving.message_rows(m).select("id", "conversation_id", "role", "content", "tool_calls").collect()))
    assert got == [("1-0", "1", "user", "hi", None), ("1-1", "1", "assistant", "ho", '["lookup"]')]
