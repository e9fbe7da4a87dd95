"""The reference's scenarios as literals, and properties that hold between operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import casts, jsonval
from palimpsest.operators import audit as A
from palimpsest.operators import changes as C
from palimpsest.operators import current as U
from palimpsest.operators import filters as P
from palimpsest.operators import lifecycle as M
from palimpsest.operators import paging as L
from palimpsest.operators import quality as V
from palimpsest.operators import scd2 as H
from palimpsest.operators import stats as G
from palimpsest.spec import AUDITED, NONE, SCD2, TableSpec, get_strategy, parse_type, register_strategy

FEED = "id string, op string, change_ts timestamp_ntz, seq long, tenant_id string, user_id string, name string, price decimal(15,2), status string, set_fields array<string>"
FIELDS = ("name", "price", "status")
SPEC = {s: TableSpec("products", FIELDS, s) for s in (NONE, AUDITED, SCD2)}


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)


def feed(spark, *rows):
    """(id, op, minute, {fields}, tenant, user) rows."""
    from decimal import Decimal

    out = []
    for seq, (i, op, minute, data, *who) in enumerate(rows):
        tenant, user = [*who, "t1", "u1"][:2] if len(who) < 2 else who
        price = Decimal(data["price"]) if data.get("price") is not None else None
        out.append((i, op, at(minute), seq, tenant, user, data.get("name"), price, data.get("status"), list(data) if op == "update" else None))
    return spark.createDataFrame(out, FEED)


def create(i, minute, name="lamp", price="12.30", status="new", *who):
    return (i, "create", minute, {"name": name, "price": price, "status": status}, *who)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_current_state_create_update_delete(spark):
    f = feed(spark, create("a", 0), ("a", "update", 1, {"price": "7.05", "status": None}, "t1", "u2"), ("a", "delete", 2, {}, "t1", "u3"))
    table = U.apply_none(None, f, SPEC[NONE])["table"]
    r = table.first()
    assert (r["name"], str(r["price"]), r["status"], r["updated_by"], r["deleted_by"]) == ("lamp", "7.05", None, "u2", "u3")
    assert P.current_rows(table, SPEC[NONE]).count() == 0 and P.current_rows(table, SPEC[NONE], include_deleted=True).count() == 1


def test_hard_delete_removes(spark):
    spec = TableSpec("t", FIELDS, NONE, soft_delete=False)
    f = feed(spark, create("a", 0), ("a", "delete", 1, {}), create("b", 0))
    assert rows(U.apply_none(None, f, spec)["table"], "id") == [("b",)]


def test_restore_in_feed_and_as_job(spark):
    f = feed(spark, create("a", 0), ("a", "delete", 1, {}), ("a", "restore", 2, {}), ("a", "restore", 3, {}), create("b", 0), ("b", "delete", 1, {}))
    out = U.apply_none(None, f, SPEC[NONE])
    assert rows(out["table"].where("deleted_at is null"), "id", "name") == [("a", "lamp")]
    assert rows(out["rejects"], "id", "reason") == [("a", "not deleted")]
    back = U.restore(out["table"], spark.createDataFrame([("b",)], "id string"), at(9), SPEC[NONE])
    assert back.where("deleted_at is null").count() == 2
    with pytest.raises(ValueError):
        U.restore(out["table"], out["table"], at(9), SPEC[SCD2])


def test_audit_trail_and_field_history(spark):
    f = feed(spark, create("a", 0, "Original", "100.00"), ("a", "update", 1, {"name": "Updated"}, "t1", "u2"), ("a", "update", 2, {"price": "150.00", "name": "Updated"}, "t1", "u3"), ("a", "update", 3, {"name": "v3"}))
    audit = A.apply_audited(None, f, SPEC[AUDITED])["audit"]
    updates = rows(audit.where("operation = 'UPDATE'"), "field_name", "old_value", "new_value", "changed_by")
    assert updates == [("name", '"Original"', '"Updated"', "u2"), ("name", '"Updated"', '"v3"', "u1"), ("price", '"100.00"', '"150.00"', "u3")]
    assert audit.where("operation = 'INSERT'").count() == 3
    assert [r["new_value"] for r in A.field_history(audit, "name").collect()] == ['"Original"', '"Updated"', '"v3"']
    assert A.change_frequency(audit).first()["n_changes"] == 6
    assert [r["field_name"] for r in A.most_changed_fields(audit, 1).collect()] == ["name"]
    assert audit.select("audit_id").distinct().count() == 6 and audit.select("transaction_id").distinct().count() == 4


def test_concurrent_updates_are_all_audited(spark):
    f = feed(spark, create("a", 0, price="100"), *(("a", "update", 1, {"price": p}) for p in ("150", "200", "250")))
    assert A.apply_audited(None, f, SPEC[AUDITED])["audit"].where("operation = 'UPDATE' and field_name = 'price'").count() == 3


def test_delete_audit_rows(spark):
    f = feed(spark, create("a", 0), ("a", "delete", 1, {}))
    soft = A.apply_audited(None, f, SPEC[AUDITED])["audit"].where("operation = 'DELETE'")
    assert rows(soft, "field_name", "new_value") == [("deleted_at", '"2024-01-01T00:01:00"')]
    hard = A.apply_audited(None, f, TableSpec("t", FIELDS, AUDITED, soft_delete=False))["audit"].where("operation = 'DELETE'")
    assert rows(hard, "field_name", "old_value", "new_value") == [("name", '"lamp"', None), ("price", '"12.30"', None), ("status", '"new"', None)]


def chain(spark):
    return feed(spark, create("a", 0, "Version 1", "100.00", "draft"), ("a", "update", 1, {"name": "Version 2", "price": "100.00"}), ("a", "update", 2, {"name": "Version 2"}), ("a", "update", 3, {"name": "Version 3", "status": None}))


def test_versions_history_and_comparison(spark):
    table = H.apply_scd2(None, chain(spark), SPEC[SCD2])["table"]
    assert rows(table, "version", "name", "valid_from", "valid_to") == [(1, "Version 1", at(0), at(1)), (2, "Version 2", at(1), at(3)), (3, "Version 3", at(3), None)]
    assert [r["name"] for r in H.version_history(table).collect()] == ["Version 1", "Version 2", "Version 3"]
    assert rows(H.version_info(table), "version", "is_current", "is_deleted") == [(1, False, False), (2, False, False), (3, True, False)]
    compared = rows(H.compare_versions(table, 1, 3, ["name", "price", "status"]), "field_name", "old_value", "new_value", "changed")
    assert compared == [("name", '"Version 1"', '"Version 3"', True), ("price", '"100.00"', '"100.00"', False), ("status", '"draft"', None, True)]
    assert H.version_deltas(table, list(FIELDS)).count() == 3
    assert P.get_version(table, "a", 2).first()["name"] == "Version 2"
    assert V.check_scd2_timeline(table).count() == 0
    assert P.as_of(table, at(2)).first()["name"] == "Version 2" and P.as_of(table, at(-1)).count() == 0


def test_tombstone_ends_the_chain(spark):
    f = feed(spark, create("a", 0), ("a", "delete", 1, {}, "t1", "u9"), ("a", "update", 2, {"name": "x"}), ("a", "delete", 3, {}), create("a", 4))
    out = H.apply_scd2(None, f, SPEC[SCD2])
    assert rows(out["table"], "version", "deleted_at", "deleted_by") == [(1, None, None), (2, at(1), "u9")]
    assert rows(out["rejects"], "op", "reason") == [("create", "exists"), ("delete", "deleted"), ("update", "deleted")]
    assert P.as_of(out["table"], at(2)).count() == 0 and P.as_of(out["table"], at(2), include_deleted=True).count() == 1


def test_rejects(spark):
    f = feed(spark, ("x", "update", 0, {"name": "n"}), create("a", 0), ("a", "update", 1, {"name": "n"}, "t2", "u"), create("b", 0, "n", "1", "s", None, "u"), create("c", 5))
    assert rows(H.apply_scd2(None, f, SPEC[SCD2])["rejects"], "id", "reason") == [("a", "wrong tenant"), ("b", "no tenant"), ("x", "not found")]
    base = H.apply_scd2(None, feed(spark, create("c", 5)), SPEC[SCD2])["table"]
    late = H.apply_scd2(base, feed(spark, ("c", "update", 1, {"name": "n"})), SPEC[SCD2])
    assert rows(late["rejects"], "reason") == [("late",)] and late["table"].count() == 1


def random_feed(spark, n=400):
    rng = random.Random(7)
    out = []
    for k in range(n):
        i, op = f"r{rng.randrange(25)}", rng.choice(["create", "update", "update", "update", "update", "delete"])
        data = {f: v for f, v in (("name", rng.choice("abc")), ("price", rng.choice(["1.00", "2.50", None])), ("status", rng.choice(["x", None]))) if op == "create" or rng.random() < 0.6}
        out.append((i, op, k, data, rng.choice(["t1", "t1", "t1", "t2"]), rng.choice(["u1", None])))
    return feed(spark, *out)


@pytest.mark.parametrize("cuts", [(200,), (50, 51, 300)])
def test_one_batch_equals_many(spark, cuts):
    f = random_feed(spark).cache()
    parts = [f.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip((0, *cuts), (*cuts, 10**9))]
    for apply, spec in ((H.apply_scd2, SPEC[SCD2]), (U.apply_none, SPEC[NONE]), (A.apply_audited, SPEC[AUDITED])):
        whole, base = apply(None, f, spec), None
        for p in parts:
            base = spark.createDataFrame(apply(base, p, spec)["table"].collect(), whole["table"].schema)
        assert sorted(map(str, base.collect())) == sorted(map(str, whole["table"].collect()))


def test_time_travel_equals_reconstruction(spark):
    f = random_feed(spark).cache()
    versions, audited = H.apply_scd2(None, f, SPEC[SCD2])["table"].cache(), A.apply_audited(None, f, SPEC[AUDITED])
    table, audit = audited["table"].cache(), audited["audit"].cache()
    for k in (10, 150, 399):
        assert sorted(map(str, P.as_of(versions, at(k)).select("id", *FIELDS).collect())) == sorted(map(str, A.reconstruct_at(table, audit, at(k), SPEC[AUDITED]).collect()))
    assert V.check_scd2_timeline(versions).count() == 0 and V.check_audit_consistency(table, audit, SPEC[AUDITED]).count() == 0
    rebuilt = H.apply_scd2(None, M.audit_to_feed(audit, SPEC[AUDITED], dict(table.dtypes)), SPEC[SCD2])["table"]
    assert rows(rebuilt, "id", "version", "valid_from", "deleted_at") == rows(versions, "id", "version", "valid_from", "deleted_at")


def test_transfers(spark):
    table = H.apply_scd2(None, feed(spark, create("a", 0), create("b", 0), ("b", "delete", 1, {})), SPEC[SCD2])["table"]
    asked = spark.createDataFrame([("a", "t2", at(9), "u"), ("b", "t2", at(9), "u"), ("zz", "t2", at(9), "u")], "id string, new_tenant_id string, change_ts timestamp_ntz, user_id string")
    out = H.transfer_ownership(table, asked, SPEC[SCD2])
    assert rows(out["table"].where("id = 'a'"), "version", "tenant_id", "valid_to") == [(1, "t1", at(9)), (2, "t2", None)]
    assert rows(out["rejects"], "id", "reason") == [("b", "deleted"), ("zz", "not found")]
    audited = A.apply_audited(None, feed(spark, create("a", 0)), SPEC[AUDITED])["table"]
    moved = A.audit_transfer(audited, asked.where("id = 'a'"), SPEC[AUDITED])
    assert moved["table"].first()["tenant_id"] == "t2" and rows(moved["audit"], "operation", "old_value", "new_value", "tenant_id") == [("TRANSFER", '"t1"', '"t2"', "t2")]


MOVES = FEED + ", new_tenant_id string"


def moves(spark, *rows):
    """(id, op, minute, name, tenant, new tenant) rows."""
    return spark.createDataFrame([(i, op, at(minute), seq, tenant, "u1", name, None, None, None if op == "create" else ["name"], new) for seq, (i, op, minute, name, tenant, new) in enumerate(rows)], MOVES)


HANDED = [
    ("a", "create", 0, "one", "t1", None), ("a", "transfer", 1, None, None, "t2"), ("a", "update", 2, "two", "t2", None), ("a", "update", 2, "no", "t1", None), ("a", "transfer", 3, None, "t1", "t3"),
    ("a", "transfer", 3, None, "t2", "t3"), ("a", "transfer", 3, None, "t3", "t3"), ("a", "transfer", 4, None, "t3", None), ("a", "update", 5, "three", "t3", None), ("a", "delete", 6, None, "t3", None), ("a", "transfer", 7, None, "t3", "t1"),
    ("b", "create", 0, "still", "t1", None), ("b", "update", 9, "here", "t1", None), ("zz", "transfer", 0, None, None, "t1"), (None, "transfer", 0, None, None, "t1"), ("c", "create", 0, "gone", None, None), ("c", "update", 1, "x", None, None), ("b", None, 9, None, "t1", None),
]


def test_transfers_among_changes(spark):
    f = moves(spark, *HANDED)
    out = H.apply_scd2(None, f, SPEC[SCD2])
    table = out["table"].cache()
    assert rows(table.where("id = 'a'"), "version", "tenant_id", "name", "valid_from") == [(1, "t1", "one", at(0)), (2, "t2", "one", at(1)), (3, "t2", "two", at(2)), (4, "t3", "two", at(3)), (5, "t3", "three", at(5)), (6, "t3", "three", at(6))]
    assert rows(table.where("id = 'b'"), "version", "tenant_id", "name") == [(1, "t1", "still"), (2, "t1", "here")]
    want = [("a", 3, "wrong tenant"), ("a", 4, "wrong tenant"), ("a", 6, "same tenant"), ("a", 7, "no tenant"), ("a", 10, "deleted"), ("b", 17, "unknown op"), ("c", 15, "no tenant"), ("c", 16, "not found"), ("zz", 13, "not found")]
    assert rows(out["rejects"].where("id is not null"), "id", "seq", "reason") == want
    assert rows(out["rejects"].where("id is null"), "seq", "new_tenant_id", "reason") == [(14, "t1", "no id")]
    audited = A.apply_audited(None, f, SPEC[AUDITED])
    audit = audited["audit"].cache()
    assert rows(audit.where("operation = 'TRANSFER'"), "changed_at", "tenant_id", "field_name", "old_value", "new_value") == [(at(1), "t2", "tenant_id", '"t1"', '"t2"'), (at(3), "t3", "tenant_id", '"t2"', '"t3"')]
    assert rows(audited["table"], "id", "tenant_id", "updated_at") == [("a", "t3", at(5)), ("b", "t1", at(9))]
    kinds = {"name": "string", "price": "decimal(15,2)", "status": "string"}
    rebuilt = H.apply_scd2(None, M.audit_to_feed(audit, SPEC[AUDITED], kinds), SPEC[SCD2])["table"].cache()
    assert sorted(map(str, rebuilt.select(*table.columns).collect())) == sorted(map(str, table.collect()))
    trail = ["record_id", "tenant_id", "field_name", "old_value", "new_value", "operation", "changed_at"]
    again = M.scd2_to_audited(rebuilt, SPEC[SCD2])["audit"]
    assert sorted(map(str, again.select(*trail).collect())) == sorted(map(str, audit.select(*trail).collect()))
    assert rows(A.reconstruct_at(audited["table"], audit, at(2), SPEC[AUDITED], with_tenant=True), "id", "name", "tenant_id") == [("a", "two", "t2"), ("b", "still", "t1")]
    spec = TableSpec("t", FIELDS, NONE, multi_tenant=False)
    assert ("unknown op",) in rows(U.apply_none(None, f, spec)["rejects"], "reason")


@pytest.mark.parametrize("cut", [1, 4])
def test_transfers_in_batches(spark, cut):
    f = moves(spark, *HANDED)
    for apply, spec in ((H.apply_scd2, SPEC[SCD2]), (U.apply_none, SPEC[NONE]), (A.apply_audited, SPEC[AUDITED])):
        whole = apply(None, f, spec)["table"]
        base = spark.createDataFrame(apply(None, f.where(F.col("change_ts") <= F.lit(at(cut))), spec)["table"].collect(), whole.schema)
        assert sorted(map(str, apply(base, f.where(F.col("change_ts") > F.lit(at(cut))), spec)["table"].collect())) == sorted(map(str, whole.collect()))


def test_two_requests_for_a_record_follow_each_other(spark):
    table = H.apply_scd2(None, feed(spark, create("a", 0)), SPEC[SCD2])["table"]
    asked = spark.createDataFrame([("a", "t3", at(9), "u"), ("a", "t2", at(8), "u"), ("a", "t3", at(10), "u"), ("a", "t1", at(-1), "u")], "id string, new_tenant_id string, change_ts timestamp_ntz, user_id string")
    out = H.transfer_ownership(table, asked, SPEC[SCD2])
    assert rows(out["table"], "version", "tenant_id", "valid_from") == [(1, "t1", at(0)), (2, "t2", at(8)), (3, "t3", at(9))] and V.check_scd2_timeline(out["table"]).count() == 0
    assert rows(out["rejects"], "new_tenant_id", "reason") == [("t1", "late"), ("t3", "same tenant")]
    audited = A.audit_transfer(A.apply_audited(None, feed(spark, create("a", 0)), SPEC[AUDITED])["table"], asked, SPEC[AUDITED])
    assert rows(audited["audit"], "old_value", "new_value") == [('"t1"', '"t2"'), ('"t2"', '"t3"')] and rows(audited["table"], "tenant_id") == [("t3",)]


def test_a_version_that_changes_tenant_and_fields(spark):
    table = H.apply_scd2(None, moves(spark, ("a", "create", 0, "one", "t1", None), ("a", "update", 1, "two", "t1", None)), SPEC[SCD2])["table"].withColumn("tenant_id", F.when(F.col("version") == 2, "t2").otherwise("t1"))
    audit = M.versions_to_audit(table, SPEC[SCD2])
    assert rows(audit.where("operation != 'INSERT'"), "operation", "field_name", "new_value", "tenant_id") == [("TRANSFER", "tenant_id", '"t2"', "t2"), ("UPDATE", "name", '"two"', "t2")]
    back = H.apply_scd2(None, M.audit_to_feed(audit, SPEC[AUDITED], {"name": "string", "price": "decimal(15,2)", "status": "string"}), SPEC[SCD2])["table"]
    assert rows(back.where("valid_to is null"), "name", "tenant_id") == [("two", "t2")]


def test_late_rows_of_tables_without_versions(spark):
    for apply, spec in ((U.apply_none, SPEC[NONE]), (A.apply_audited, SPEC[AUDITED])):
        base = apply(None, feed(spark, create("a", 0), ("a", "update", 10, {"name": "ten"})), spec)["table"]
        out = apply(base, feed(spark, ("a", "update", 5, {"name": "five"}), ("a", "update", 11, {"status": "old"})), spec)
        assert rows(out["table"], "name", "status", "updated_at") == [("ten", "old", at(11))] and rows(out["rejects"], "reason") == [("late",)]


def test_reconstruction_after_hard_deletes(spark):
    spec = TableSpec("t", FIELDS, AUDITED, soft_delete=False)
    first = A.apply_audited(None, feed(spark, create("a", 0, "one"), ("a", "update", 2, {"name": "two"}), ("a", "delete", 5, {}), create("b", 4)), spec)
    second = A.apply_audited(first["table"], feed(spark, create("a", 8, "again")), spec)  # a second life under the same id
    table, audit = second["table"].cache(), first["audit"].unionByName(second["audit"]).cache()
    state = lambda k: rows(A.reconstruct_at(table, audit, at(k), spec), "id", "name")
    assert [state(k) for k in (-1, 1, 4, 6, 9)] == [[], [("a", "one")], [("a", "two"), ("b", "lamp")], [("b", "lamp")], [("a", "again"), ("b", "lamp")]]


def test_json_of_any_text_and_number(spark):
    import json

    texts = ["plain", 'q"uo\\te', "".join(map(chr, range(1, 32))), "é 😀 \u2028", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsonval.audit_json(F.col("t"), "string").alias("j")).select("t", "j", jsonval.audit_value(F.col("j"), "string").alias("back")).collect()
    assert all(r["t"] == (None if r["j"] is None else json.loads(r["j"])) == r["back"] for r in got)
    numbers = spark.createDataFrame([(float("nan"),), (float("inf"),), (-2.5e300,), (None,)], "x double").select(jsonval.audit_json(F.col("x"), "double").alias("j"))
    assert [r["j"] and json.loads(r["j"]) for r in numbers.collect()] == ["NaN", "Infinity", -2.5e300, None]
    assert [str(r[0]) for r in numbers.select(jsonval.audit_value(F.col("j"), "double")).collect()] == ["nan", "inf", "-2.5e+300", "None"]


def test_one_log_for_table_audit_and_rejects(spark, tmp_path):
    from palimpsest.sources.tables import written

    f = random_feed(spark)
    log = []
    out = A.apply_audited(None, f, SPEC[AUDITED], keep=lambda df: log.append(written(df, str(tmp_path / "log"))) or log[0])
    plain = A.apply_audited(None, f, SPEC[AUDITED])
    for name in ("table", "audit", "rejects"):
        assert sorted(map(str, out[name].collect())) == sorted(map(str, plain[name].collect()))
    plan = A.reconstruct_at(out["table"], out["audit"], at(200), SPEC[AUDITED])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # the log is only read
    assert plain["rejects"]._jdf.queryExecution().executedPlan().toString().count("lead(") == 0


def test_tenants_and_counts(spark):
    f = feed(spark, *((f"{t}-{k}", "create", k, {"name": "n", "price": "1", "status": "active" if k % 2 == 0 else "idle"}, t, "u") for t, n in (("t1", 3), ("t2", 5), ("t3", 2)) for k in range(n)))
    table = U.apply_none(None, f, SPEC[NONE])["table"]
    count = lambda **k: P.tenant_scope(table, **k).count()
    assert (count(tenant_id="t1"), count(tenant_ids=["t1", "t2", "t1"]), count(), count(tenant_ids=["t1"], filters={"tenant_id": "t3"})) == (3, 8, 10, 2)
    assert {r["tenant_id"]: r["n"] for r in G.count_rows(table, SPEC[NONE], ("tenant_id",)).collect()} == {"t1": 3, "t2": 5, "t3": 2}
    for bad in ({"tenant_id": "a", "tenant_ids": ["b"]}, {"tenant_ids": []}):
        with pytest.raises(ValueError):
            P.tenant_scope(table, **bad)
    inside, outside = C.check_tenant(spark.createDataFrame([("t1",), ("t9",), (None,)], "tenant_id string"), ["t1"])
    assert inside.count() == 1 and rows(outside, "reason") == [("no tenant",), ("outside scope",)]


def test_filters_on_reserved_names(spark):
    df = spark.createDataFrame([(100, True, "x"), (5, False, None)], "limit int, select boolean, `a.b` string")
    assert P.filter_by(df, {"limit": 100, "select": True}).count() == 1 and P.filter_by(df, {"a.b": None}).count() == 1
    assert P.filter_by(df, {"limit": 100, "select": False}, "OR").count() == 2 and P.filter_by(df, {}).count() == 2
    for bad in (lambda: P.filter_by(df, {"limit": []}), lambda: P.filter_allowed(df, {"select": True}, ["limit"]), lambda: P.filter_by(df, {}, "XOR"), lambda: L.validated_order(df, "limit", ["select"]), lambda: L.validated_order(df, "limit", ["limit"], "UP")):
        with pytest.raises(ValueError):
            bad()
    assert P.escape_like(r"50%_\x[") == r"50\%\_\\x["
    for bad in (lambda: U.update_where(df, {}, {"limit": 1}), lambda: U.delete_where(df, {})):
        with pytest.raises(ValueError):
            bad()


def test_field_groups():
    for strategy in (NONE, AUDITED, SCD2):
        for tenant in (True, False):
            for soft in (True, False):
                spec = TableSpec("t", ("name", "value"), strategy, soft, tenant)
                system = {"id", "created_at", "updated_at", "created_by", "updated_by"} | ({"tenant_id"} if tenant else set())
                system |= {"deleted_at", "deleted_by"} if soft or strategy == SCD2 else set()
                system |= {"valid_from", "valid_to", "version"} if strategy == SCD2 else set()
                assert set(spec.system_fields) == system and spec.user_fields == ("name", "value") and set(spec.columns) == system | {"name", "value"}
    schema = TableSpec("t", ("name",)).full_schema(T.StructType([T.StructField("name", T.StringType())]))
    assert schema["version"].dataType == T.IntegerType() and not schema["id"].nullable
    with pytest.raises(ValueError):
        TableSpec("t", (), "other")


def test_strategies_can_be_registered(spark):
    assert get_strategy(SCD2) is H.apply_scd2 and get_strategy(NONE) is U.apply_none
    register_strategy("mine", lambda base, feed, spec: {"table": feed})
    assert get_strategy("mine")(None, 1, None) == {"table": 1} and TableSpec("t", (), "mine").strategy == "mine"


def test_type_names():
    assert parse_type("NUMERIC(10,2)") == T.DecimalType(10, 2) and parse_type("decimal") == T.DecimalType(15, 2)
    assert parse_type("BIGINT") == T.LongType() and parse_type("varchar(50)") == T.StringType() and parse_type("UUID[]") == T.ArrayType(T.StringType())
    assert parse_type("TIMESTAMP WITH TIME ZONE") == T.TimestampType() and parse_type("whatever") == T.StringType()


def test_audit_json_round_trip(spark):
    kinds = {"s": "string", "d": "decimal(10,2)", "b": "binary", "t": "timestamp_ntz", "i": "int", "f": "boolean", "a": "array<int>", "day": "date"}
    df = spark.sql("SELECT 'q\"\\n\\\\x' AS s, CAST(1.50 AS DECIMAL(10,2)) AS d, X'0aFF' AS b, TIMESTAMP_NTZ '2024-01-01 10:00:00.5' AS t, 7 AS i, true AS f, array(1, 2) AS a, DATE '2024-02-03' AS day")
    text = df.select(*(jsonval.audit_json(F.col(c), k).alias(c) for c, k in kinds.items()))
    r = text.first()
    assert (r["d"], r["b"], r["t"], r["i"], r["f"], r["a"], r["day"]) == ('"1.50"', '"0aff"', '"2024-01-01T10:00:00.500000"', "7", "true", "[1,2]", '"2024-02-03"')
    assert text.select(*(jsonval.audit_value(F.col(c), k).alias(c) for c, k in kinds.items())).first() == df.first()
    decoded = spark.createDataFrame([('{"k": 1}',), ("not json",), (None,)], "c string").select(jsonval.json_decode(F.col("c"), "k int").alias("v")).collect()
    assert decoded[0]["v"]["value"]["k"] == 1 and decoded[1]["v"]["raw"] == "not json" and decoded[2]["v"]["value"] is None


def test_strict_casts(spark):
    df = spark.createDataFrame([("12", "yes", "[1]"), ("", "", ""), (None, None, None)], "n string, b string, j string")
    out = df.select(casts.strict_cast(F.col("n"), "int").alias("n"), casts.strict_cast(F.col("b"), "boolean").alias("b"), casts.strict_cast(F.col("j"), "json").alias("j")).collect()
    assert [tuple(r) for r in out] == [(12, True, "[1]"), (None, None, "[]"), (None, None, "[]")]
    for value, kind in (("x", "int"), ("maybe", "boolean"), ("123", "uuid"), ("99999999999", "int")):
        with pytest.raises(Exception, match="not a"):
            spark.createDataFrame([(value,)], "c string").select(casts.strict_cast(F.col("c"), kind)).collect()


def test_evolution(spark):
    df = spark.createDataFrame([("1", None), ("2", "x")], "a string, b string")
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType(), False), T.StructField("c", T.LongType())])
    assert M.schema_changes(df.schema, want) == [("add", "c"), ("type", "a"), ("not_null", "b")]
    with pytest.raises(ValueError):
        M.evolve_table(df, want)
    assert rows(M.evolve_table(df, want, {"b": "?", "c": 0}), "a", "b", "c") == [(1, "?", 0), (2, "x", 0)]
    fewer = T.StructType(want.fields[:1])
    assert M.evolve_table(df, fewer).columns == ["a", "b"] and M.evolve_table(df, fewer, allow_destructive=True).columns == ["a"]


def test_retention(spark):
    f = feed(spark, create("a", 0), *(("a", "update", k, {"name": f"n{k}"}) for k in range(1, 6)), create("b", 0), ("b", "delete", 1, {}))
    table = H.apply_scd2(None, f, SPEC[SCD2])["table"]
    kept, old = M.archive_versions(table, 2)
    assert rows(kept.where("id = 'a'"), "version") == [(5,), (6,)] and old.count() == 4
    assert M.prune_versions(table, 2, tenant="other").count() == table.count()
    assert rows(M.purge_deleted(table, at(5), SPEC[SCD2]), "id")[0] == ("a",) and M.purge_deleted(table, at(5), SPEC[SCD2]).count() == 6
    assert M.purge_deleted(table, at(5), SPEC[SCD2], tombstone_only=True).count() == 7
    assert M.scd2_to_none(table, SPEC[SCD2]).columns == ["id", *FIELDS, "created_at", "updated_at", "created_by", "updated_by", "tenant_id"]
    assert L.latest_per_key(table).count() == 2 and L.list_page(table, 3, 1).count() == 3


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    s = spark.createDataFrame([(2, "c", 9), (3, "d", 8), (3, "e", 7)], "k int, v string, n int")
    assert rows(U.upsert(t, s, ["k"], ["v"], [F.desc("n")]), "k", "v", "n") == [(1, "a", 1), (2, "c", 2), (3, "d", 8)]


def _ties(spark, spec, values=("a", "b", "c")):
    """Twenty records that are created, then changed twice at one instant."""
    from palimpsest.operators.audit import apply_audited

    rows = [(str(k), op, at(t), seq, "t", "u", v) for k in range(20) for op, t, seq, v in (("create", 0, 0, values[0]), ("update", 5, 1, values[1]), ("update", 5, 2, values[2]))]
    return apply_audited(None, spark.createDataFrame(rows, "id string, op string, change_ts timestamp_ntz, seq long, tenant_id string, user_id string, name string"), spec)


def test_changes_of_one_instant_keep_their_order(spark):
    from palimpsest.operators.audit import reconstruct_at
    from palimpsest.operators.lifecycle import audit_to_feed
    from palimpsest.operators.quality import check_audit_consistency
    from palimpsest.operators.scd2 import apply_scd2
    from palimpsest.spec import AUDITED, SCD2, TableSpec

    spec = TableSpec("t", ("name",), AUDITED)
    out = _ties(spark, spec)
    assert {r["name"] for r in reconstruct_at(out["table"], out["audit"], at(3), spec).collect()} == {"a"}
    again = apply_scd2(None, audit_to_feed(out["audit"], spec, {"name": "string"}), TableSpec("t", ("name",), SCD2))["table"]
    assert {r["name"] for r in again.where("valid_to is null").collect()} == {"c"}
    assert check_audit_consistency(out["table"], out["audit"], spec).count() == 0


def test_restore_is_rejected_where_versions_are_kept(spark):
    from palimpsest.operators.quality import check_scd2_timeline
    from palimpsest.spec import AUDITED, NONE, SCD2, TableSpec, get_strategy

    rows = [("a", op, at(k), k, "t", "u", v) for k, (op, v) in enumerate((("create", "x"), ("delete", None), ("restore", None), ("update", "y"), ("merge", "z")))]
    feed = spark.createDataFrame(rows, "id string, op string, change_ts timestamp_ntz, seq long, tenant_id string, user_id string, name string")
    for strategy in (SCD2, AUDITED, NONE):
        out = get_strategy(strategy)(None, feed, TableSpec("t", ("name",), strategy))
        reasons = [r["reason"] for r in out["rejects"].orderBy("seq").collect()]
        assert reasons == (["unknown op"] if strategy == NONE else ["no restore", "deleted", "unknown op"])
        if strategy == SCD2:
            assert check_scd2_timeline(out["table"]).count() == 0 and out["table"].count() == 2


def test_new_not_null_column_needs_a_default(spark):
    import pytest
    from pyspark.sql import types as T

    from palimpsest.operators.lifecycle import evolve_table

    wanted = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType(), False)])
    df = spark.range(3).toDF("a")
    with pytest.raises(ValueError, match="b is added NOT NULL"):
        evolve_table(df, wanted)
    assert {r["b"] for r in evolve_table(df, wanted, {"b": "x"}).collect()} == {"x"}


def test_jobs_do_not_shuffle_a_bucketed_table(spark, tmp_path):
    from palimpsest.operators import joins as J
    from palimpsest.sources.tables import save_bucketed

    f = random_feed(spark)
    whole = H.apply_scd2(None, f, SPEC[SCD2])["table"]
    base = save_bucketed(H.apply_scd2(None, f.where("seq < 250"), SPEC[SCD2])["table"], "bucketed_products", str(tmp_path / "t"), buckets=4)
    facts = f.select(F.col("id").alias("product"), F.col("seq").alias("fact"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = J.join_current(facts, base, "product")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "is_open" in plan.split("PartitionFilters: ")[1].split("]")[0]
        asof = J.join_asof(facts.withColumn("at", F.lit(at(100))), base, "product", "at", ["name"])
        assert asof._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        out = H.apply_scd2(base, f.where("seq >= 250"), SPEC[SCD2])["table"]
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        scans = [k for k, line in enumerate(lines) if "bucketed_products" in line and "FileScan" in line]
        above = lambda k: next(line for line in reversed(lines[:k]) if not any(x in line for x in ("Filter", "Project", "ColumnarToRow")))
        assert scans and all("Exchange" not in above(k) for k in scans)
        assert sorted(map(str, out.collect())) == sorted(map(str, whole.select(*out.columns).collect()))
        assert "parent_is_open" not in joined.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql("DROP TABLE bucketed_products")


def test_transfers_where_a_join_is_broadcast_late(spark):
    """The records with transfers turn out few: their join's shuffle is read as it lies, and the fold still needs a record's rows together."""
    handed = [(f"r{k % 300}", op, k // 300, name, tenant, new) for k, (op, name, tenant, new) in enumerate(step for step in (("create", "a", "t1", None), ("transfer", None, "t1", "t2"), ("update", "b", "t2", None), ("transfer", None, None, "t3"), ("update", "c", "t3", None)) for _ in range(300))]
    f = moves(spark, *handed).repartition(8, "id", "seq").cache()
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        out = H.apply_scd2(None, f, SPEC[SCD2])
        plan = C.by_fold(C.with_base(None, f, SPEC[SCD2]), SPEC[SCD2])._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "RepartitionByExpression" not in plan  # a window demands its rows' place, a repartition doesn't
        assert out["rejects"].count() == 0
        assert rows(out["table"].where("valid_to is null").groupBy("version", "tenant_id", "name").count(), "version", "tenant_id", "name", "count") == [(5, "t3", "c", 300)]
    finally:
        for name in conf:
            spark.conf.unset(name)
