import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.keys import metadata_keys, metadata_keys_back, object_key, with_prefix, without_prefix
from palimpsest.operators import stats as G
from palimpsest.sources import objects as O
from palimpsest.sources import snapshots as X
from palimpsest.sources import tables as S


@pytest.fixture
def store(tmp_path):
    for key, data in {"docs/file1.txt": b"12345678", "docs/file2.txt": bytes(range(250)) * 40, "images/pic.jpg": b"x"}.items():
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "docs/file1.txt.meta.json").write_text(json.dumps({"kind": "text", "by": "me"}))
    return str(tmp_path)


def test_inventory_and_metadata(spark, store):
    assert [(r["key"], r["size"]) for r in O.object_inventory(spark, store).collect()] == [("docs/file1.txt", 8), ("docs/file2.txt", 10000), ("images/pic.jpg", 1)]
    assert O.object_inventory(spark, store, "docs").count() == 2 and O.object_inventory(spark, store, limit=2).count() == 2 and O.object_inventory(spark, store, "no").count() == 0
    assert {r["key"]: r["metadata"] for r in O.object_metadata(spark, store).collect()} == {"docs/file1.txt": {"kind": "text", "by": "me"}, "docs/file2.txt": {}, "images/pic.jpg": {}}


def test_chunks_rebuild_the_object(spark, store):
    chunks = O.object_chunks(spark, store, 1024).where("key = 'docs/file2.txt'").orderBy("chunk").collect()
    assert len(chunks) == 10 and b"".join(bytes(c["bytes"]) for c in chunks) == bytes(range(250)) * 40
    whole = {k: v for k, v in (("docs/file1.txt", b"12345678"), ("docs/file2.txt", bytes(range(250)) * 40), ("images/pic.jpg", b"x"))}
    for chunk, span in ((7, 100), (1000, 1000), (1, 4096), (20000, 1)):
        parts = {}
        for r in O.object_chunks(spark, store, chunk, span).collect():
            parts[r["key"], r["chunk"]] = bytes(r["bytes"])
        assert {k: b"".join(parts[k, n] for n in range(-(-len(v) // chunk))) for k, v in whole.items()} == whole and len(parts) == sum(-(-len(v) // chunk) for v in whole.values())


def test_a_large_object_is_read_by_many_tasks(spark, tmp_path):
    big = tmp_path / "odd name %20 é.bin"
    with big.open("wb") as f:  # 3 GB, almost all of it a hole
        f.seek((3 << 30) - 1)
        f.write(b"\x01")
    chunks = O.object_chunks(spark, str(tmp_path), 16 << 20, 256 << 20)
    got = chunks.select("chunk", F.length("bytes").alias("n"), F.spark_partition_id().alias("task"), F.crc32(F.right("bytes", F.lit(1))).alias("last")).collect()
    assert sorted(r["chunk"] for r in got) == list(range(192)) and sum(r["n"] for r in got) == 3 << 30 and len({r["task"] for r in got}) > 4
    assert len({r["last"] for r in got if r["chunk"] < 191}) == 1 and {r["last"] for r in got if r["chunk"] == 191} != {r["last"] for r in got if r["chunk"] == 0}


def test_keys(spark):
    keys = [("../etc/passwd",), ("test/../../outside",), ("/etc/passwd",), ("a/../b",), ("a/b",)]
    assert [r[0] for r in spark.createDataFrame(keys, "k string").select(object_key(F.col("k"))).collect()] == [None, None, "etc/passwd", "a/../b", "a/b"]
    r = spark.sql("SELECT map('a-b', 1, 'c.d', 2) m, 'x/y' k").select(metadata_keys(F.col("m")).alias("m"), with_prefix(F.col("k"), "/p/").alias("p"), without_prefix(F.col("k"), "x").alias("w")).first()
    assert r["m"] == {"a_b": "1", "c_d": "2"} and r["p"] == "p/x/y" and r["w"] == "y"
    assert spark.sql("SELECT map('a_b', '1') m").select(metadata_keys_back(F.col("m"))).first()[0] == {"a-b": "1"}


def test_tables_are_replaced_and_appended(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.range(3), path)
    S.write_table(S.read_table(spark, path).select((F.col("id") + 1).alias("id")), path)
    S.bulk_write(spark.range(10, 12), path)
    assert sorted(r["id"] for r in S.read_table(spark, path).collect()) == [1, 2, 3, 10, 11]
    parts = str(tmp_path / "p")
    S.write_table(spark.range(6).withColumn("m", F.col("id") % 2), parts, ["m"])
    S.write_table(spark.range(10, 11).withColumn("m", F.lit(0)), parts, ["m"])
    assert sorted(r["id"] for r in S.read_table(spark, parts).collect()) == [1, 3, 5, 10]
    assert S.fetch_one(spark, "SELECT * FROM {t} WHERE id > :a ORDER BY id", {"a": 2}, t=spark.range(9)).first()["id"] == 3


def test_jdbc_options():
    out = S.jdbc_options("jdbc:x", "t", "id", (0, 100), 8)
    assert out["numPartitions"] == "8" and out["partitionColumn"] == "id" and "numPartitions" not in S.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        S.jdbc_options("jdbc:x", "t", partitions=4)


def test_pool_statistics(spark):
    rows = [(1, 10, 10, 2, "2024-01-01 00:00:00"), (1, 10, 5, 0, "2024-01-01 00:01:00"), (2, 0, 0, 1, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "pool int, pool_size int, active_connections int, waiting_requests int, timestamp string")
    got = {r["pool"]: (r["latest_utilisation"], r["avg_utilisation"], r["exhaustions"]) for r in G.pool_stats(df).collect()}
    assert got == {1: (50.0, 75.0, 1), 2: (0.0, 0.0, 1)}


def test_readers_see_the_table_before_or_after(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.write_table(spark.range(3), path) == 1
    before = S.read_table(spark, path)
    assert S.write_table(before.select((F.col("id") + 10).alias("id")), path, since=1) == 2
    assert sorted(r["id"] for r in before.collect()) == [0, 1, 2]  # what was begun with
    assert sorted(r["id"] for r in S.read_table(spark, path).collect()) == [10, 11, 12]
    assert S.read_table(spark, path, snapshot=1).count() == 3
    with pytest.raises(X.ConcurrentWrite):
        S.write_table(spark.range(1), path, since=1)
    with pytest.raises(ValueError):
        S.read_table(spark, path, snapshot=9)
    with pytest.raises(ValueError):
        S.bulk_write(spark.range(1).toDF("other"), path)
    assert S.read_table(spark, path).count() == 3


def test_a_partition_overwrite_is_one_step(spark, tmp_path):
    path = str(tmp_path / "p")
    S.write_table(spark.range(6).selectExpr("id", "id % 3 as m", "if(id % 2 = 0, null, 'a b/c') as k"), path, ["m", "k"])
    S.write_table(spark.range(10, 12).selectExpr("id", "id - 10 as m", "cast(null as string) as k"), path, ["m", "k"])
    got = sorted((r["m"], r["k"] or "", r["id"]) for r in S.read_table(spark, path).collect())
    assert got == [(0, "", 10), (0, "a b/c", 3), (1, "", 11), (1, "a b/c", 1), (2, "", 2), (2, "a b/c", 5)]
    assert S.read_table(spark, path, snapshot=1).count() == 6
    with pytest.raises(ValueError):
        S.write_table(spark.range(1).selectExpr("id", "id as m", "'x' as k"), path, ["m"])


@pytest.mark.parametrize("step", ["_add_folder", "_publish"])
def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    S.write_table(spark.range(3), path)

    def crash(*args):
        if step == "_add_folder":
            spark.range(2).write.parquet(f"{path}/data/half")
        raise OSError("lost")

    monkeypatch.setattr(X, step, crash)
    for write in (S.write_table, S.bulk_write):
        with pytest.raises(Exception):
            write(spark.range(9), path)
    monkeypatch.undo()
    assert S.read_table(spark, path).count() == 3
    S.bulk_write(spark.range(2), path)
    assert S.read_table(spark, path).count() == 5
    X.vacuum(spark, path, keep=1, orphan_hours=-1)
    assert S.read_table(spark, path).count() == 5 and len(list((tmp_path / "t/data").iterdir())) == 2


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: S.bulk_write(spark.range(k * 10, k * 10 + 3), path), range(8)))
    assert sorted(numbers) == list(range(1, 9)) and S.read_table(spark, path).distinct().count() == 24
    assert X.compact(spark, path) == 9 and len(X.snapshot(spark, path).parts) == 1
    old = S.read_table(spark, path, snapshot=8)
    assert X.vacuum(spark, path, keep=2) == 0 and old.count() == 24  # the last but one has them all
    assert X.vacuum(spark, path, keep=1) == 8 and S.read_table(spark, path).count() == 24 and X.snapshots(spark, path) == [9]


def test_jdbc_parts_cover_every_row_once(spark):
    url = "jdbc:derby:memory:parts;create=true"
    rows = [(k, None if k % 10 == 0 else 7 if k % 3 == 0 else k) for k in range(1000)]
    S.write_jdbc(spark.createDataFrame(rows, "id int, v int"), url, "numbers")
    for column in ('"v"', '"id"'):  # as the database quotes them
        predicates = S.jdbc_predicates(spark, url, "numbers", column, 5)
        df = S.read_jdbc_parts(spark, url, "numbers", column, 5)
        assert df.rdd.getNumPartitions() == len(predicates) and sorted(r["id"] for r in df.collect()) == list(range(1000))
    sizes = df.rdd.glom().map(len).collect()
    assert max(sizes) < 230
    assert {'"v" = 7', '"v" IS NULL'} <= set(S.jdbc_predicates(spark, url, "numbers", '"v"', 5))
    assert S.read_jdbc_parts(spark, url, "numbers", '"v"', 1).count() == 1000
    with pytest.raises(ValueError):
        S.write_jdbc(spark.createDataFrame([("a",)], "t string"), url, "texts") or S.jdbc_predicates(spark, url, "texts", '"t"', 2)
