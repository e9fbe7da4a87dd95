import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.audit import apply_audited
from palimpsest.operators.current import apply_none
from palimpsest.operators.scd2 import apply_scd2
from palimpsest.spec import AUDITED, NONE, SCD2, TableSpec
from palimpsest.streaming import feeds as R

SPEC = TableSpec("t", ("name", "level"), SCD2, multi_tenant=False)
FEED = "id string, op string, change_ts timestamp_ntz, seq long, tenant_id string, user_id string, name string, level string"


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def texts(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def random_rows(n=60, seed=3):
    rng = random.Random(seed)
    return [(f"r{rng.randrange(8)}", rng.choice(["create", "update", "update", "update", "delete"]), at(k // 2), k, "t", "u", rng.choice("ab"), rng.choice(["1", None])) for k in range(n)]


@pytest.mark.parametrize("strategy, soft", [(SCD2, True), (AUDITED, True), (AUDITED, False)])
def test_streamed_tables_equal_a_batch(spark, tmp_path, strategy, soft):
    """Several changes of a record in one instant, over more batches than deltas are kept."""
    spec = TableSpec("t", ("name", "level"), strategy, soft_delete=soft, multi_tenant=False)
    rows, path = random_rows(), str(tmp_path / "table")
    apply = R.table_batch(path, spec, buckets=4)
    assert R.read_current(spark, path) is None and R.read_audit(spark, path) is None
    for n, k in enumerate(range(0, 60, 20)):
        batch = spark.createDataFrame(rows[k : k + 20], FEED)
        apply(batch, n)
        if n == 1:
            apply(batch, n)  # run again
    feed = spark.createDataFrame(rows, FEED)
    if strategy == SCD2:
        whole = apply_scd2(None, feed, spec)
        assert texts(R.read_versions(spark, path), *whole["table"].columns) == texts(whole["table"], *whole["table"].columns)
    else:
        whole = (apply_audited if strategy == AUDITED else apply_none)(None, feed, spec)
        columns = whole["table"].columns
        got = R.read_current(spark, path)
        lives = soft or strategy == NONE
        if lives:  # without soft delete, a deleted id may be created again by a later batch
            assert texts(got, *columns) == texts(whole["table"], *columns)
            assert texts(R.read_rejects(spark, path), "id", "seq", "reason") == texts(whole["rejects"], "id", "seq", "reason")
        if strategy == AUDITED and soft:
            assert texts(R.read_audit(spark, path), *whole["audit"].columns) == texts(whole["audit"], *whole["audit"].columns)
    assert len(os.listdir(f"{path}/state")) <= 3 and R.runs_at(5) == [5, 4] and R.runs_at(12) == [12, 8]


def test_stream_and_replay(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    parts = [[("a", "create", at(0), 0, "t", "u", "x", "1"), ("b", "create", at(1), 1, "t", "u", "y", "1")], [("a", "update", at(2), 2, "t", "u", "z", "1"), ("b", "delete", at(3), 3, "t", "u", None, None)]]
    for k, part in enumerate(parts):
        written(spark, source, part, FEED)
        R.stream_scd2(spark.readStream.schema(FEED).parquet(source), table, str(tmp_path / "state"), SPEC, buckets=4).awaitTermination(120)
        assert R.read_versions(spark, table).count() == (2, 4)[k]
    feed = spark.read.schema(FEED).parquet(source)
    R.table_batch(table, SPEC, buckets=4)(feed, 7)
    whole = apply_scd2(None, feed, SPEC)["table"]
    assert texts(R.read_versions(spark, table), *whole.columns) == texts(whole, *whole.columns) and R.read_rejects(spark, table).isEmpty()


@pytest.mark.parametrize("horizon", [100, 1])
def test_replays_beyond_the_horizon_change_nothing(spark, tmp_path, horizon):
    table = str(tmp_path / "table")
    apply = R.table_batch(table, SPEC, horizon=horizon, buckets=4)
    first = [("a", "create", at(0), 0, "t", "u", "x", "1"), ("a", "update", at(5), 1, "t", "u", "y", "1"), ("b", "create", at(1), 2, "t", "u", "n", "1")]
    apply(spark.createDataFrame(first, FEED), 0)
    apply(spark.createDataFrame([("c", "create", at(6), 3, "t", "u", "n", "1")], FEED), 1)
    apply(spark.createDataFrame(first, FEED), 2)
    assert texts(R.read_versions(spark, table), "id", "version", "name") == sorted(map(str, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "n"), ("c", 1, "n")], "id string, version int, name string").collect()))
    reasons = sorted((r["id"], r["reason"]) for r in R.read_rejects(spark, table).collect())
    assert reasons == ([] if horizon == 100 else [("a", "late"), ("b", "exists")])


def test_bytes_written_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "table")
    apply = R.table_batch(path, SPEC, buckets=2)
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
    apply(spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.lit("create").alias("op"), F.lit(at(0)).alias("change_ts"), F.col("id").alias("seq"), F.lit("t").alias("tenant_id"), F.lit("u").alias("user_id"), F.md5(F.col("id").cast("string")).alias("name"), F.lit("1").alias("level")), 0)
    large = size()
    small = lambda k: spark.createDataFrame([(str(k), "update", at(k), 10**6 + k, "t", "u", "new", "2")], FEED)
    apply(small(1), 1)  # the second delta takes in the first
    before = size()
    apply(small(2), 2)
    assert size() - before < large / 20
    assert R.read_versions(spark, path).count() == 40_002 and R.read_current(spark, path).count() == 40_000


def test_rows_wait_for_those_that_come_late(spark, tmp_path):
    path = str(tmp_path / "table")
    apply = R.table_batch(path, SPEC, delay=dt.timedelta(minutes=10), buckets=4)
    rows = [("a", "create", at(0), 0, "t", "u", "one", "1"), ("a", "update", at(3), 1, "t", "u", "two", "1"), ("a", "update", at(6), 2, "t", "u", "three", "1"), ("a", "update", at(20), 3, "t", "u", "four", "1")]
    apply(spark.createDataFrame([rows[0], rows[2]], FEED), 0)
    assert R.read_versions(spark, path) is None  # all of them may be overtaken
    apply(spark.createDataFrame([rows[1], rows[3]], FEED), 1)
    names = lambda: [r["name"] for r in R.read_versions(spark, path).orderBy("version").collect()]
    assert names() == ["one", "two", "three"]
    apply(spark.createDataFrame([rows[1], rows[3]], FEED), 1)
    assert names() == ["one", "two", "three"]
    R.flush(spark, path, SPEC, buckets=4)
    R.flush(spark, path, SPEC, buckets=4)
    assert names() == ["one", "two", "three", "four"] and R.read_rejects(spark, path).isEmpty()


@pytest.mark.parametrize("step", ["versions", "state", "commit"])
def test_a_crash_between_the_writes_is_made_good(spark, tmp_path, monkeypatch, step):
    from pyspark.sql.readwriter import DataFrameWriter

    path = str(tmp_path / "table")
    rows = random_rows(24)
    apply = R.table_batch(path, SPEC, buckets=4)
    apply(spark.createDataFrame(rows[:12], FEED), 0)
    before = texts(R.read_versions(spark, path), "id", "version", "name", "valid_to")
    parquet = DataFrameWriter.parquet

    def fails(*args, **named):
        raise OSError("lost")

    if step == "commit":
        monkeypatch.setattr(R, "_write_commit", fails)
    else:
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to, *a, **k: fails() if f"/{step}/" in to else parquet(self, to, *a, **k))
    with pytest.raises(OSError):
        apply(spark.createDataFrame(rows[12:], FEED), 1)
    monkeypatch.undo()
    assert texts(R.read_versions(spark, path), "id", "version", "name", "valid_to") == before
    apply(spark.createDataFrame(rows[12:], FEED), 1)
    whole = apply_scd2(None, spark.createDataFrame(rows, FEED), SPEC)["table"]
    assert texts(R.read_versions(spark, path), *whole.columns) == texts(whole, *whole.columns)


def test_stream_query_stats_drop_late_rows(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "timestamp timestamp, operation string, duration double, success boolean"
    for part in ([(at(5), "q", 0.5, True), (at(50), "q", 2.0, False)], [(at(200), "q", 1.0, True)], [(at(10), "q", 9.0, True), (at(400), "q", 1.0, True)]):
        written(spark, source, part, schema)
        out = R.stream_query_stats(spark.readStream.schema(schema).parquet(source))
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
        R.stream_late_rows(spark.readStream.schema(schema).parquet(source), str(tmp_path / "late"), str(tmp_path / "late_state")).awaitTermination(120)
    assert [(r["timestamp"], r["duration"]) for r in R.read_late_rows(spark, str(tmp_path / "late")).collect()] == [(at(10), 9.0)]
    first = spark.read.parquet(str(tmp_path / "out")).where(F.col("window_start") == F.lit(at(0))).collect()
    assert [(r["total"], r["succeeded"], r["slow"], r["max_duration"]) for r in first] == [(2, 1, 1, 2.0)]


def test_replayed_batches_and_rejects(spark, tmp_path):
    table = str(tmp_path / "table")
    apply = R.table_batch(table, SPEC, buckets=4)
    # One row comes twice within the batch.
    first = spark.createDataFrame([("a", "create", at(0), 0, "t", "u", "x", "1"), ("a", "create", at(0), 0, "t", "u", "x", "1"), ("a", "update", at(5), 1, "t", "u", "y", "1"), ("b", "update", at(1), 2, "t", "u", "n", "1")], FEED)
    # The same instant as the last version's, and a late row.
    second = spark.createDataFrame([("a", "update", at(5), 3, "t", "u", "z", "1"), ("a", "update", at(2), 4, "t", "u", "w", "1")], FEED)
    apply(first, 0)
    apply(second, 1)
    rows = lambda: sorted((r["id"], r["version"], r["name"]) for r in R.read_versions(spark, table).collect())
    wanted = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")]
    assert rows() == wanted
    apply(second, 1)  # the same batch again
    apply(first.unionByName(second), 2)  # the same rows in a later batch
    assert rows() == wanted
    assert sorted((r["id"], r["seq"], r["reason"]) for r in R.read_rejects(spark, table).collect()) == [("a", 4, "late"), ("b", 2, "not found")]
