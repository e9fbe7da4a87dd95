"""One query for each operator over the given tables, with the same in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, jsonval, keys
from ..operators import audit as A
from ..operators import changes as C
from ..operators import current as U
from ..operators import filters as P
from ..operators import joins as J
from ..operators import lifecycle as M
from ..operators import paging as L
from ..operators import quality as V
from ..operators import scd2 as H
from ..operators import stats as G
from ..sources import objects as O
from ..sources import tables as S
from ..streaming import feeds as R
from ..spec import AUDITED, NONE, TableSpec
from .feeds import AUDITED_SPEC, CHAIN_SQL, CURRENT, DAYS_SQL, FIELDS, MOVES_SQL, VERSIONED, audited, audited_once, current, dealt, feed, moving_feed, query_log, scratch, table, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

T1, T2 = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)
AT, FROM_, TO = "TIMESTAMP '2024-01-15 00:00:00'", "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
NOW = dt.datetime(2024, 1, 15)
USER = ", ".join(FIELDS)
AUDIT_COLUMNS = "record_id, tenant_id, field_name, old_value, new_value, operation, changed_at, changed_by"
_AUDIT = AUDIT_COLUMNS.split(", ")


def query(name: str, sql: str | None = None, chain: bool = False):
    """Register a query and its SQL; chain puts the feed's expressions before it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (CHAIN_SQL if chain else "") + sql
        return f

    return add


def on_versions(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, chain=True)(lambda s, d: f(versions(s, d)))


def on_audit(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, chain=True)(lambda s, d: f(audited(s, d)["audit"]))


def on_table(name: str, of: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda s, d: f(table(s, d, of)))


def on_current(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, chain=True)(lambda s, d: f(current(s, d)))


# Sources.
query("read_table", "SELECT * FROM nation")(lambda s, d: S.read_table(s, f"{d}/nation.parquet"))
query("read_sql", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000.0")(
    lambda s, d: S.read_sql(s, "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = :segment AND c_acctbal > :least", {"segment": "BUILDING", "least": 5000.0}, customer=table(s, d, "customer"))
)

# Projections, filters, predicates.
on_table("filter_by", "orders", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'", lambda t: P.filter_by(t, {"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_orderstatus"))
on_table("filter_by_or", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority IS NULL OR o_custkey IN (1, 2, 3)", lambda t: P.filter_by(t, {"o_orderstatus": "P", "o_orderpriority": None, "o_custkey": [1, 2, 3]}, "OR").select("o_orderkey"))
on_table("filter_allowed", "part", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size = 11", lambda t: P.filter_allowed(t, {"p_brand": "Brand#2", "p_size": 11}, ["p_brand", "p_size"]).select("p_partkey"))
on_table("tenant_scope", "customer", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 5, 7) AND c_mktsegment = 'MACHINERY'", lambda t: P.tenant_scope(t, "c_nationkey", tenant_ids=[1, 5, 7, 5], filters={"c_mktsegment": "MACHINERY"}).select("c_custkey", "c_nationkey"))
on_table("select_columns", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10", lambda t: P.select_columns(t, ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "O", [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 10))
on_versions("current_rows", f"SELECT id, {USER}, version FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL", lambda v: P.current_rows(v, VERSIONED).select("id", *FIELDS, "version"))
on_versions("include_deleted", "SELECT id, version, deleted_at FROM versions WHERE valid_to IS NULL", lambda v: P.current_rows(v, VERSIONED, include_deleted=True).select("id", "version", "deleted_at"))
on_versions("as_of", f"SELECT id, {USER}, version FROM versions WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) AND (deleted_at IS NULL OR deleted_at > {AT})", lambda v: P.as_of(v, NOW).select("id", *FIELDS, "version"))
on_versions("get_version", "SELECT id, event_type, level FROM versions WHERE version = 2", lambda v: P.get_versions(v, v.select("id", F.lit(2).alias("version")).distinct()).select("id", "event_type", "level"))
on_versions("user_fields", f"SELECT {USER} FROM versions", lambda v: v.select(*VERSIONED.user_fields))
on_table("drop_computed", "part", "SELECT p_partkey, p_size FROM part", lambda t: P.drop_computed(P.with_computed(t.select("p_partkey", "p_size"), {"double_size": F.col("p_size") * 2}), ["double_size"]))
on_table("like_literal", "events", """SELECT event_id FROM events WHERE props LIKE '%"k": 1%'""", lambda t: P.like_literal(t, "props", '"k": 1').select("event_id"))

# Applying changes.
query("apply_none", "SELECT * FROM current_state", chain=True)(lambda s, d: current(s, d))
query("apply_scd2", "SELECT * FROM versions", chain=True)(lambda s, d: versions(s, d))
query("scd2_suppress_noop", "SELECT (SELECT count(*) FROM accepted) - (SELECT count(*) FROM kept) AS suppressed", chain=True)(
    lambda s, d: C.united(C.judged(None, feed(s, d), VERSIONED), lambda r: C.with_states(r.where("reason is null"), VERSIONED)).agg(F.count(F.when((F.col("op") == "update") & ~F.col("changed"), 1)).alias("suppressed"))
)
on_versions("scd2_delete", "SELECT id, version, deleted_at, deleted_by, updated_by FROM versions WHERE deleted_at IS NOT NULL", lambda v: v.where("deleted_at is not null").select("id", "version", "deleted_at", "deleted_by", "updated_by"))
query("apply_audited", f"SELECT {AUDIT_COLUMNS} FROM audit", chain=True)(lambda s, d: audited(s, d)["audit"].select(*_AUDIT))
query("apply_scd2_batches", "SELECT * FROM versions", chain=True)(lambda s, d: _in_two_batches(s, d))


def _in_two_batches(s: SparkSession, d: str) -> DataFrame:
    """The feed in two parts at an instant gives the table that it gives at once."""
    f = feed(s, d)
    base = S.written(H.apply_scd2(None, f.where(F.col("change_ts") <= F.lit(NOW)), VERSIONED)["table"], scratch(s, "versions"))
    later = S.written(f.where(F.col("change_ts") > F.lit(NOW)), scratch(s, "later"))
    return H.apply_scd2(base, dealt(later, later.count()), VERSIONED)["table"]


def _transfers(s: SparkSession, d: str) -> dict[str, DataFrame]:
    v = S.written(versions(s, d), scratch(s, "versions"))
    requests = v.select("id").distinct().select("id", F.lit("4").alias("new_tenant_id"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("change_ts"), F.lit("9").alias("user_id"))
    return H.transfer_ownership(v, requests, VERSIONED)


query("transfer_ownership", "SELECT id, '4' AS tenant_id, version + 1 AS version, event_type, level FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL AND tenant_id <> '4'", chain=True)(
    lambda s, d: _transfers(s, d)["table"].where(F.col("valid_from") == F.lit(dt.datetime(2024, 3, 1))).select("id", "tenant_id", "version", "event_type", "level")
)
query("transfer_rejects", "SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' ELSE 'same tenant' END AS reason FROM versions WHERE valid_to IS NULL AND (deleted_at IS NOT NULL OR tenant_id = '4')", chain=True)(lambda s, d: _transfers(s, d)["rejects"].select("id", "reason"))
on_current("restore", "SELECT id, CASE WHEN deleted_at IS NOT NULL AND level > 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE updated_at END AS updated_at, CASE WHEN level > 0 THEN NULL ELSE deleted_at END AS deleted_at FROM current_state",
           lambda c: U.restore(c, c.where("level > 0"), dt.datetime(2024, 3, 1), CURRENT).select("id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "deleted_at"))
query("upsert", """
    WITH s AS (SELECT c_custkey + 1000 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)
    SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, c.c_name) AS c_name, CASE WHEN c.c_custkey IS NULL THEN s.c_nationkey ELSE c.c_nationkey END AS c_nationkey,
           CASE WHEN c.c_custkey IS NULL THEN s.c_acctbal ELSE c.c_acctbal END AS c_acctbal, CASE WHEN c.c_custkey IS NULL THEN s.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment
    FROM customer c FULL JOIN s ON c.c_custkey = s.c_custkey""")(lambda s, d: _upserted(table(s, d, "customer")))  # fmt: skip


def _upserted(c: DataFrame) -> DataFrame:
    return U.upsert(c, c.withColumns({"c_custkey": F.col("c_custkey") + 1000, "c_name": F.concat(F.lit("new "), "c_name")}), ["c_custkey"], ["c_name"])


query("rejected_changes", "SELECT id, op, change_ts, seq, tenant_id, reason FROM judged WHERE reason IS NOT NULL", chain=True)(lambda s, d: H.apply_scd2(None, feed(s, d), VERSIONED)["rejects"])
on_table("force_tenant", "customer", "SELECT c_custkey, 'acme' AS tenant_id FROM customer", lambda t: C.force_tenant(t.select("c_custkey"), "acme"))
query("check_tenant", "SELECT id, seq, tenant_id, 'outside scope' AS reason FROM feed WHERE tenant_id NOT IN ('0', '1', '2')", chain=True)(lambda s, d: C.check_tenant(feed(s, d).select("id", "seq", "tenant_id"), ["0", "1", "2"])[1])
on_table("create_defaults", "nation", "SELECT md5(n_name) AS digest, 'active' AS status FROM nation", lambda t: C.create_defaults(t, VERSIONED, ["n_name"], {"status": F.lit("active")}).select(F.replace("id", F.lit("-"), F.lit("")).alias("digest"), "status"))
on_table("update_where", "customer", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer", lambda t: U.update_where(t, {"c_acctbal": 0.0}, {"c_mktsegment": "MACHINERY"}).select("c_custkey", "c_acctbal"))
on_table("delete_where", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'", lambda t: U.delete_where(t, {"c_mktsegment": "MACHINERY"}).select("c_custkey"))

# Audit trail.
for _op in ("INSERT", "UPDATE", "DELETE"):
    on_audit(f"audit_{_op.lower()}", f"SELECT record_id, field_name, old_value, new_value, changed_at, changed_by FROM audit WHERE operation = '{_op}'", lambda a, o=_op: a.where(F.col("operation") == o).select("record_id", "field_name", "old_value", "new_value", "changed_at", "changed_by"))
on_audit("audit_history", f"SELECT {AUDIT_COLUMNS} FROM audit WHERE record_id IN (SELECT record_id FROM audit WHERE operation = 'DELETE')", lambda a: A.audit_history(a, a.where("operation = 'DELETE'").select("record_id")).select(*_AUDIT))
on_audit("field_history", "SELECT record_id, old_value, new_value, changed_at FROM audit WHERE field_name = 'level'", lambda a: A.field_history(a, "level").select("record_id", "old_value", "new_value", "changed_at"))
on_audit("changes_by_user", f"SELECT {AUDIT_COLUMNS} FROM audit WHERE changed_by = '3' AND changed_at BETWEEN {FROM_} AND {TO} ORDER BY changed_at DESC, record_id, field_name LIMIT 100", lambda a: A.changes_by_user(a, "3", T1, T2).select(*_AUDIT))
on_audit("changes_in_range", f"SELECT {AUDIT_COLUMNS} FROM audit WHERE changed_at BETWEEN {FROM_} AND {TO} AND operation = 'UPDATE'", lambda a: A.changes_in_range(a, T1, T2, "UPDATE").select(*_AUDIT))
query("reconstruct_at", f"SELECT id, {USER} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) AS rn FROM accepted WHERE change_ts <= {AT}) WHERE rn = 1 AND op <> 'delete'", chain=True)(
    lambda s, d: (lambda r: A.reconstruct_at(r["table"], r["audit"], NOW, AUDITED_SPEC))(audited_once(s, d))
)
on_audit("change_frequency", "SELECT record_id, field_name, count(*) AS n_changes FROM audit GROUP BY ALL", lambda a: A.change_frequency(a, by_field=True))
on_audit("most_changed_fields", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY record_id ORDER BY n_changes DESC, field_name) AS INTEGER) AS rank FROM (SELECT record_id, field_name, count(*) AS n_changes FROM audit GROUP BY ALL)) WHERE rank <= 2", lambda a: A.most_changed_fields(a, 2))
on_audit("transactions", "SELECT record_id, changed_at, array_to_string(list_sort(list(field_name)), ',') AS fields FROM audit GROUP BY record_id, changed_at, seq", lambda a: A.transactions(a).select("record_id", "changed_at", F.array_join("fields", ",").alias("fields")))

# Versions.
on_versions("version_history", "SELECT id, version, event_type, valid_from FROM versions WHERE id IN (SELECT id FROM versions WHERE version = 5)", lambda v: H.version_history(v, v.where("version = 5")).select("id", "version", "event_type", "valid_from"))
on_versions("version_info", "SELECT id, version, valid_from, valid_to, valid_to IS NULL AS is_current, deleted_at IS NOT NULL AS is_deleted FROM versions", H.version_info)
on_versions("compare_versions", """
    SELECT a.id, 'event_type' AS field_name, '"' || a.event_type || '"' AS old_value, '"' || b.event_type || '"' AS new_value, a.event_type <> b.event_type AS changed FROM versions a JOIN versions b ON a.id = b.id AND a.version = 1 AND b.version = 3
    UNION ALL SELECT a.id, 'level', CAST(a.level AS VARCHAR), CAST(b.level AS VARCHAR), a.level <> b.level FROM versions a JOIN versions b ON a.id = b.id AND a.version = 1 AND b.version = 3""", lambda v: H.compare_versions(v, 1, 3, ["event_type", "level"]))  # fmt: skip
on_versions("version_deltas", "SELECT record_id AS id, version, field_name, old_value, new_value FROM audit JOIN (SELECT id, version, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_ts, seq) AS version FROM kept)) n ON record_id = n.id AND audit.seq = n.seq WHERE operation = 'UPDATE'",
            lambda v: H.version_deltas(v, list(FIELDS)).withColumn("version", F.col("version").cast("long")))
on_versions("version_count", "SELECT id, count(*) AS n_versions FROM versions GROUP BY id", H.version_count)
on_versions("version_timeline", "SELECT id, version, valid_from, valid_to, epoch_us(valid_to) - epoch_us(valid_from) AS valid_micros FROM versions", H.version_timeline)
on_versions("changes_between", f"SELECT id, version, valid_from FROM versions WHERE valid_from BETWEEN {FROM_} AND {TO}", lambda v: H.changes_between(v, T1, T2).select("id", "version", "valid_from"))
on_versions("first_time_value", "SELECT id, min(valid_from) AS first_at FROM versions WHERE event_type = 'purchase' GROUP BY id", lambda v: H.first_time_value(v, "event_type", "purchase"))
on_versions("histories_for", "SELECT id, version, level FROM versions WHERE id IN (SELECT id FROM versions WHERE deleted_at IS NOT NULL)", lambda v: H.version_history(v, v.where("deleted_at is not null")).select("id", "version", "level"))


# Joins.
def _facts(s: SparkSession, d: str) -> DataFrame:
    """Purchases as facts of the records, three days after their events."""
    f = feed(s, d).where("event_type = 'purchase'")
    return f.select(F.col("seq").alias("fact"), F.col("id").alias("record"), (F.col("change_ts") + F.expr("INTERVAL 3 DAYS")).alias("happened"))


_FACTS = ", facts AS (SELECT seq AS fact, id AS record, change_ts + INTERVAL 3 DAY AS happened FROM feed WHERE event_type = 'purchase')"
_ASOF = " SELECT fact, record, happened, p.version AS parent_version, p.level AS parent_level FROM facts f LEFT JOIN versions p ON f.record = p.id AND p.valid_from <= f.happened AND (p.valid_to IS NULL OR p.valid_to > f.happened) AND (p.deleted_at IS NULL OR p.deleted_at > f.happened)"
query("get_many", "SELECT i.id, c.level FROM (SELECT DISTINCT id FROM raw) i LEFT JOIN (SELECT * FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL) c ON i.id = c.id", chain=True)(lambda s, d: J.get_many(feed(s, d), J.current_view(versions(s, d))).select("id", "level"))
query("join_current", "SELECT fact, record, p.level AS parent_level, p.version AS parent_version FROM facts JOIN versions p ON record = p.id AND valid_to IS NULL AND deleted_at IS NULL".join((_FACTS + " ", "")), chain=True)(lambda s, d: J.join_current(_facts(s, d), versions(s, d), "record").select("fact", "record", "parent_level", "parent_version"))
query("join_at", f"{_FACTS} SELECT fact, record, p.version AS parent_version FROM facts JOIN versions p ON record = p.id AND valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) AND (deleted_at IS NULL OR deleted_at > {AT}) WHERE happened <= {AT}", chain=True)(lambda s, d: J.join_at(_facts(s, d), versions(s, d), NOW, "record", "happened").select("fact", "record", "parent_version"))


def _bucketed(s: SparkSession, d: str) -> DataFrame:
    """The versions as a bucketed table of the catalog."""
    path = scratch(s, "bucketed")
    return S.save_bucketed(versions(s, d), f"versions_{path[-32:]}", path, buckets=int(s.conf.get("spark.sql.shuffle.partitions")))


query("join_current_bucketed", "SELECT fact, record, p.level AS parent_level, p.version AS parent_version FROM facts JOIN versions p ON record = p.id AND valid_to IS NULL AND deleted_at IS NULL".join((_FACTS + " ", "")), chain=True)(lambda s, d: J.join_current(_facts(s, d), _bucketed(s, d), "record").select("fact", "record", "parent_level", "parent_version"))
query("join_asof", _FACTS + _ASOF, chain=True)(lambda s, d: J.join_asof(_facts(s, d), versions(s, d), "record", "happened", ["version", "level"]))
query("join_asof_skewed", _FACTS + _ASOF, chain=True)(lambda s, d: J.join_asof(_facts(s, d), versions(s, d), "record", "happened", ["version", "level"], skewed=True))
query("orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")(lambda s, d: J.orphans(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_nationkey < 20"), "o_custkey", "c_custkey"))
query("parent_not_current", f"{_FACTS} SELECT fact, record, happened FROM facts WHERE record IN (SELECT id FROM versions) AND record NOT IN (SELECT id FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL)", chain=True)(lambda s, d: J.parent_not_current(_facts(s, d), versions(s, d), "record"))
on_versions("current_view", f"SELECT id, {USER}, version FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL", lambda v: J.current_view(v).select("id", *FIELDS, "version"))
for _rule, _sql in (("RESTRICT", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"), ("CASCADE", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"), ("SET NULL", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ON o_custkey = c_custkey")):
    query(f"fk_delete_rule_{_rule.lower().replace(' ', '_')}", _sql)(lambda s, d, r=_rule: J.fk_delete_rule(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_nationkey = 3"), "o_custkey", r, "c_custkey"))
query("hierarchy", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id * 1000 + p.turn = c.conv_id * 1000 + c.turn - 1 AND p.conv_id = c.conv_id")(
    lambda s, d: J.hierarchy(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("before"), "conv_id", "turn", "role"), "before", ["role"]).select("conv_id", "turn", "parent_role")
)

# Aggregations.
on_versions("count_rows", "SELECT tenant_id, count(*) AS n FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL GROUP BY tenant_id", lambda v: G.count_rows(v, VERSIONED, ("tenant_id",)))
on_versions("count_all_versions", "SELECT tenant_id, count(*) AS n FROM versions GROUP BY tenant_id", lambda v: G.count_rows(v, VERSIONED, ("tenant_id",), all_versions=True))
_LOG = 'WITH log AS (SELECT event_id AS id, ts AS "timestamp", event_type AS operation, value AS duration, event_type <> \'error\' AS success FROM events) '
query("query_stats", _LOG + f"""SELECT operation, count(*) AS total, CAST(sum(CAST(success AS INTEGER)) AS BIGINT) AS succeeded, CAST(count(*) - sum(CAST(success AS INTEGER)) AS BIGINT) AS failed, sum(CAST(success AS INTEGER)) * 100.0 / count(*) AS success_rate,
    round(avg(duration), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, count(*) FILTER (WHERE duration > 1.0) AS slow FROM log WHERE "timestamp" > {AT} - INTERVAL 1440 MINUTE AND "timestamp" <= {AT} GROUP BY operation""")(lambda s, d: G.query_stats(query_log(s, d), NOW, 1440, by=("operation",)).withColumn("avg_duration", F.round("avg_duration", 6)))  # fmt: skip
query("timing_stats", _LOG + "SELECT operation, count(*) AS n, round(avg(duration), 6) AS mean, min(duration) AS min, max(duration) AS max, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99 FROM log GROUP BY operation")(
    lambda s, d: G.timing_stats(query_log(s, d), "operation").select("operation", "n", F.round("mean", 6).alias("mean"), "min", "max", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))
)
query("operation_counts", _LOG + "SELECT operation, count(*) FILTER (WHERE success) AS success, count(*) FILTER (WHERE NOT success) AS failed FROM log GROUP BY operation")(lambda s, d: G.operation_counts(query_log(s, d), "operation"))
query("slow_queries", _LOG + 'SELECT id, operation, duration FROM log WHERE duration > 1.0 ORDER BY "timestamp" DESC, id LIMIT 100')(lambda s, d: G.slow_queries(query_log(s, d), tie=("id",)).select("id", "operation", "duration"))
query("pool_stats", """
    WITH s AS (SELECT user_id % 10 AS pool, ts, event_id % 20 AS size, CAST(floor(value) AS BIGINT) % 20 AS active, event_id % 3 AS waiting FROM events),
    r AS (SELECT *, CASE WHEN size > 0 THEN active * 100.0 / size ELSE 0.0 END AS u, row_number() OVER (PARTITION BY pool ORDER BY ts DESC) AS rn FROM s)
    SELECT pool, max(ts) AS latest_at, arg_max(u, ts) AS latest_utilisation, arg_max(active, ts) AS latest_active, round(avg(u), 6) AS avg_utilisation, count(*) FILTER (WHERE active >= size AND waiting > 0) AS exhaustions, count(*) AS samples FROM r WHERE rn <= 100 GROUP BY pool""")(
    lambda s, d: G.pool_stats(table(s, d, "events").select((F.col("user_id") % 10).alias("pool"), F.col("ts").alias("timestamp"), (F.col("event_id") % 20).alias("pool_size"), (F.floor("value").cast("long") % 20).alias("active_connections"), (F.col("event_id") % 3).alias("waiting_requests"))).withColumn("avg_utilisation", F.round("avg_utilisation", 6))
)
on_table("duplicates", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", lambda t: G.duplicates(t, ["l_orderkey", "l_linenumber"]))

# Windows, sorts, limits.
on_current("list_page", "SELECT id, created_at FROM current_state ORDER BY created_at DESC, id LIMIT 100 OFFSET 50", lambda c: L.list_page(c, 100, 50).select("id", "created_at"))
on_current("page_after", f"SELECT id, created_at FROM current_state WHERE created_at < {AT} ORDER BY created_at DESC, id LIMIT 100", lambda c: L.page_after(c, NOW, "~").select("id", "created_at"))
on_table("validated_order", "nation", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC", lambda t: L.validated_order(t.select("n_nationkey", "n_name"), "n_name", ["n_name"], "DESC"))
on_versions("rank_versions", "SELECT id, version, CAST(row_number() OVER (PARTITION BY id ORDER BY version DESC) AS INTEGER) AS rn FROM versions", lambda v: L.rank_versions(v).select("id", "version", "rn"))
on_versions("latest_per_key", "SELECT id, max(version) AS version, arg_max(level, version) AS level FROM versions GROUP BY id", lambda v: L.latest_per_key(v).select("id", "version", "level"))

# Scalar functions.
on_table("audit_json", "customer", """SELECT c_custkey, '"' || c_name || '"' AS j_name, '"' || CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS VARCHAR) || '"' AS j_balance, CAST(c_nationkey AS VARCHAR) AS j_nation FROM customer""",
         lambda t: t.select("c_custkey", jsonval.audit_json(F.col("c_name"), "string").alias("j_name"), jsonval.audit_json(F.col("c_acctbal").cast("decimal(15,2)"), "decimal(15,2)").alias("j_balance"), jsonval.audit_json(F.col("c_nationkey"), "int").alias("j_nation")))
on_table("audit_value", "customer", "SELECT c_custkey, c_name, c_acctbal AS balance FROM customer",
         lambda t: t.select("c_custkey", jsonval.audit_value(jsonval.audit_json(F.col("c_name"), "string"), "string").alias("c_name"), jsonval.audit_value(jsonval.audit_json(F.col("c_acctbal").cast("decimal(15,2)"), "decimal(15,2)"), "decimal(15,2)").cast("double").alias("balance")))
on_table("json_encode_decode", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", lambda t: t.select("event_id", jsonval.json_decode(jsonval.json_encode(F.from_json("props", "k long"), "struct"), "k long").getField("value").getField("k").alias("k")))
on_table("iso_timestamp", "events", "SELECT event_id, CASE WHEN CAST(date_part('microseconds', ts) AS BIGINT) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events", lambda t: t.select("event_id", jsonval.iso_timestamp(F.col("ts")).alias("iso")))
on_table("strict_cast", "orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS customer FROM orders",
         lambda t: t.select("o_orderkey", casts.strict_cast(F.substring("o_orderpriority", 1, 1), "int").alias("priority"), casts.strict_cast(F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")), "bigint").alias("customer")))
on_table("parse_bool", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS flag FROM orders", lambda t: t.select("o_orderkey", casts.parse_bool(F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "yes").otherwise("")).alias("flag")))
on_table("array_operators", "part", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 = 0 AS has_all, p_size % 2 = 0 OR p_size % 3 = 0 AS has_any, p_size % 5 <> 0 AS within FROM part",
         lambda t: t.withColumn("a", F.filter(F.array(*(F.when(F.col("p_size") % k == 0, k) for k in (2, 3, 5))), lambda x: x.isNotNull())).select("p_partkey", casts.array_contains_all(F.col("a"), F.array(F.lit(2), F.lit(3))).alias("has_all"), casts.array_overlaps(F.col("a"), F.array(F.lit(2), F.lit(3))).alias("has_any"), casts.array_within(F.col("a"), F.array(F.lit(2), F.lit(3))).alias("within")))
on_table("json_list_to_array", "part", "SELECT p_partkey, CAST(p_size + 7 AS BIGINT) AS total FROM part", lambda t: t.select("p_partkey", F.aggregate(casts.json_list_to_array(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", 7]")), "long"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))

# Lifecycle.
on_audit("archive_audit", f"SELECT record_id, field_name, changed_at, changed_at < {AT} AS archived FROM audit", lambda a: (lambda keep, old: keep.withColumn("archived", F.lit(False)).unionByName(old.withColumn("archived", F.lit(True))).select("record_id", "field_name", "changed_at", "archived"))(*M.archive_audit(S.written(a.select("record_id", "field_name", "changed_at"), scratch(a.sparkSession, "audit")), NOW)))
on_versions("prune_versions", "SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM versions) WHERE rn <= 2", lambda v: M.prune_versions(v, 2).select("id", "version"))
on_versions("archive_versions", "SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM versions WHERE tenant_id = '1') WHERE rn > 2", lambda v: M.archive_versions(v, 2, "1")[1].select("id", "version"))
on_versions("purge_deleted", f"SELECT id, version FROM versions WHERE id NOT IN (SELECT id FROM versions WHERE deleted_at < {AT})", lambda v: M.purge_deleted(v, NOW, VERSIONED).select("id", "version"))
on_table("add_temporal", "customer", "SELECT *, 'acme' AS tenant_id, CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS VARCHAR) AS deleted_by, TIMESTAMP '2024-01-10 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, 1 AS version FROM customer", lambda t: M.add_temporal(t, VERSIONED, T1, "acme").withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")))
query("audit_to_scd2", f"SELECT id, {USER}, valid_from, valid_to, version FROM (SELECT id, {USER}, change_ts AS valid_from, lead(change_ts) OVER w AS valid_to, CAST(row_number() OVER w AS INTEGER) AS version FROM kept WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq))", chain=True)(lambda s, d: _from_audit(audited(s, d)["audit"]))


def _rebuilt(audit: DataFrame) -> DataFrame:
    """Versions from an audit trail, which is a stored table."""
    kinds = {"event_type": "string", "level": "bigint", "props": "string"}
    stored = S.written(audit, scratch(audit.sparkSession, "audit"))
    return H.apply_scd2(None, M.audit_to_feed(stored, AUDITED_SPEC, kinds), VERSIONED)["table"]


def _from_audit(audit: DataFrame) -> DataFrame:
    return _rebuilt(audit).select("id", *FIELDS, "valid_from", "valid_to", "version")


on_versions("scd2_to_audited", f"SELECT id, {USER}, deleted_at FROM versions WHERE valid_to IS NULL", lambda v: M.scd2_to_audited(v, VERSIONED)["table"].select("id", *FIELDS, "deleted_at"))
on_versions("scd2_to_none", f"SELECT id, {USER}, created_at, updated_at, created_by, updated_by, tenant_id FROM versions WHERE valid_to IS NULL AND deleted_at IS NULL", lambda v: M.scd2_to_none(v, VERSIONED))
_WANTED = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType(), False), T.StructField("c_nationkey", T.LongType()), T.StructField("c_status", T.StringType(), False)])
on_table("evolve_table", "customer", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, 'active' AS c_status FROM customer", lambda t: M.evolve_table(t, _WANTED, {"c_status": "active", "c_name": "?"}, allow_destructive=True))

# Data quality.
on_versions("check_not_null", "SELECT 'updated_by' AS rule, count(*) FILTER (WHERE updated_by IS NULL) AS violations FROM versions UNION ALL SELECT 'level', count(*) FILTER (WHERE level IS NULL) FROM versions", lambda v: V.check_not_null(v, ["updated_by", "level"]))
on_table("check_range", "customer", "SELECT 'balance' AS rule, count(*) FILTER (WHERE c_acctbal < 0) AS violations FROM customer UNION ALL SELECT 'nation', count(*) FILTER (WHERE NOT (c_nationkey BETWEEN 0 AND 20)) FROM customer", lambda t: V.check_range(t, {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey").between(0, 20)}))
on_table("check_length", "part", "SELECT 'p_name' AS rule, count(*) FILTER (WHERE NOT (length(p_name) BETWEEN 1 AND 9)) AS violations FROM part", lambda t: V.check_length(t, {"p_name": (1, 9)}))
on_table("check_unique", "orders", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1", lambda t: V.check_unique(t, ["o_custkey", "o_orderdate"]))
on_versions("check_scd2_timeline", """
    SELECT id, version, CASE WHEN n <> version THEN 'version gap' WHEN nv IS NOT NULL AND valid_to IS NULL THEN 'open before the last' WHEN nv IS NULL AND valid_to IS NOT NULL THEN 'no open version'
                             WHEN nv IS NOT NULL AND valid_to <> nf THEN 'periods don''t meet' ELSE 'version after tombstone' END AS problem
    FROM (SELECT *, row_number() OVER w AS n, lead(valid_from) OVER w AS nf, lead(version) OVER w AS nv, lag(deleted_at IS NOT NULL) OVER w AS after
          FROM (SELECT id, version, valid_from, CASE WHEN version = 3 THEN NULL WHEN version = 4 THEN valid_from + INTERVAL 1 HOUR ELSE valid_to END AS valid_to, CASE WHEN version = 1 THEN valid_from ELSE deleted_at END AS deleted_at FROM versions WHERE version <> 6)
          WINDOW w AS (PARTITION BY id ORDER BY version))
    WHERE n <> version OR nv IS NOT NULL AND valid_to IS NULL OR nv IS NULL AND valid_to IS NOT NULL OR nv IS NOT NULL AND valid_to <> nf OR coalesce(after, false)""",
            lambda v: V.check_scd2_timeline(v.where("version != 6").withColumns({"valid_to": F.when(F.col("version") == 3, None).when(F.col("version") == 4, F.col("valid_from") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("valid_to")), "deleted_at": F.when(F.col("version") == 1, F.col("valid_from")).otherwise(F.col("deleted_at"))})))
query("check_audit_consistency", "SELECT id AS record_id, 'level' AS field_name, 'last value' AS problem FROM current_state WHERE level > 3", chain=True)(
    lambda s, d: (lambda r: V.check_audit_consistency(r["table"].withColumn("level", F.when(F.col("level") > 3, F.col("level") + 1).otherwise(F.col("level"))), r["audit"], AUDITED_SPEC))(audited_once(s, d))
)
on_table("tenant_leaks", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)", lambda t: V.tenant_leaks(t, [1, 2, 3], "c_nationkey").select("c_custkey"))


# The same instant for many changes of a record.
def on_days(name: str, sql: str, f: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda s, d: f(audited_once(s, d, days=True))
    ORACLE_SQL[name] = DAYS_SQL + sql


on_days("reconstruct_at_ties", f"SELECT id, {USER} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) AS rn FROM accepted WHERE change_ts <= {AT}) WHERE rn = 1 AND op <> 'delete'", lambda r: A.reconstruct_at(r["table"], r["audit"], NOW, AUDITED_SPEC))
on_days("audit_to_scd2_ties", f"SELECT id, {USER}, valid_from, valid_to, version FROM (SELECT id, {USER}, change_ts AS valid_from, lead(change_ts) OVER w AS valid_to, CAST(row_number() OVER w AS INTEGER) AS version FROM kept WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq))", lambda r: _from_audit(r["audit"]))
on_days("check_audit_consistency_ties", "SELECT record_id, field_name, 'old value' AS problem FROM audit WHERE operation = 'UPDATE' AND field_name = 'level' AND CAST(new_value AS BIGINT) % 3 = 0", lambda r: V.check_audit_consistency(r["table"], r["audit"].withColumn("old_value", F.when((F.col("operation") == "UPDATE") & (F.col("field_name") == "level") & (F.col("new_value").try_cast("long") % 3 == 0), F.concat("old_value", F.lit("0"))).otherwise(F.col("old_value"))), AUDITED_SPEC))

# Forms of the record jobs that the queries above leave out.
on_versions("scd2_to_audited_trail", f"SELECT {AUDIT_COLUMNS} FROM audit", lambda v: M.scd2_to_audited(v, VERSIONED)["audit"].select(*_AUDIT))
_HARD = TableSpec("activity", FIELDS, AUDITED, soft_delete=False)
_HARD_ROWS = " UNION ALL ".join(f"SELECT e.id, owner, '{f}', {j}, NULL, 'DELETE', change_ts, user_id FROM encoded e JOIN owners USING (id) WHERE op = 'delete'" for f, j in zip(FIELDS, ("j_type", "j_level", "j_props")))
query("audit_hard_delete", f"SELECT {AUDIT_COLUMNS} FROM audit WHERE operation <> 'DELETE' UNION ALL {_HARD_ROWS}", chain=True)(lambda s, d: A.apply_audited(None, feed(s, d), _HARD)["audit"].select(*_AUDIT))
query("apply_none_hard_delete", f"SELECT id, {USER}, tenant_id FROM current_state WHERE deleted_at IS NULL", chain=True)(lambda s, d: U.apply_none(None, feed(s, d), TableSpec("activity", FIELDS, NONE, soft_delete=False))["table"].select("id", *FIELDS, "tenant_id"))


def _audit_transfers(s: SparkSession, d: str) -> dict[str, DataFrame]:
    c = S.written(current(s, d), scratch(s, "current"))
    requests = c.select("id", F.when(F.col("level") != 2, F.lit("4")).alias("new_tenant_id"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("change_ts"), F.lit("9").alias("user_id"))
    return A.audit_transfer(c, requests, AUDITED_SPEC)


query("audit_transfer", """SELECT id AS record_id, '4' AS tenant_id, '"' || tenant_id || '"' AS old_value, '"4"' AS new_value, '9' AS changed_by FROM current_state WHERE deleted_at IS NULL AND tenant_id <> '4' AND level <> 2""", chain=True)(lambda s, d: _audit_transfers(s, d)["audit"].select("record_id", "tenant_id", "old_value", "new_value", "changed_by"))
query("audit_transfer_rejects", "SELECT id, CASE WHEN level = 2 THEN 'no tenant' WHEN deleted_at IS NOT NULL THEN 'deleted' ELSE 'same tenant' END AS reason FROM current_state WHERE level = 2 OR deleted_at IS NOT NULL OR tenant_id = '4'", chain=True)(lambda s, d: _audit_transfers(s, d)["rejects"].select("id", "reason"))
query("transfer_closed", "SELECT id, version, CASE WHEN valid_to IS NULL AND deleted_at IS NULL AND tenant_id <> '4' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE valid_to END AS valid_to FROM versions", chain=True)(lambda s, d: _transfers(s, d)["table"].where(F.col("valid_from") != F.lit(dt.datetime(2024, 3, 1))).select("id", "version", "valid_to"))
on_versions("count_include_deleted", "SELECT tenant_id, count(DISTINCT id) AS n FROM versions GROUP BY tenant_id", lambda v: G.count_rows(v, VERSIONED, ("tenant_id",), include_deleted=True))
on_table("tenant_scope_strict", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey = 5", lambda t: P.tenant_scope(t, "c_nationkey", tenant_id=5).select("c_custkey"))
query("add_audit", """SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'c_name' AS field_name, '"' || c_name || '"' AS new_value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""")(
    lambda s, d: M.add_audit(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey"), TableSpec("customers", ("c_name", "c_nationkey"), AUDITED), T1, "importer", "acme")["audit"].select("record_id", "field_name", "new_value")
)

query("reconstruct_at_hard_delete", f"SELECT id, {USER} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) AS rn FROM accepted WHERE change_ts <= {AT}) WHERE rn = 1 AND op <> 'delete'", chain=True)(
    lambda s, d: (lambda r: A.reconstruct_at(r["table"], r["audit"], NOW, _HARD))(audited_once(s, d, spec=_HARD))
)


# Transfers among the feed's rows.
def on_moves(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda s, d: f(moving_feed(s, d))
    ORACLE_SQL[name] = MOVES_SQL + sql


_VERSION = ["id", *FIELDS, "tenant_id", "valid_from", "valid_to", "version", "updated_by", "deleted_at"]
on_moves("apply_scd2_transfers", f"SELECT {', '.join(_VERSION)} FROM versions", lambda f: H.apply_scd2(None, f, VERSIONED)["table"].select(*_VERSION))
on_moves("apply_none_transfers", "SELECT * FROM current_state", lambda f: U.apply_none(None, f, CURRENT)["table"].drop("created_at", "created_by", "deleted_by"))
on_moves("apply_audited_transfers", f"SELECT {AUDIT_COLUMNS} FROM audit", lambda f: A.apply_audited(None, f, AUDITED_SPEC)["audit"].select(*_AUDIT))
on_moves("rejected_transfers", "SELECT id, op, change_ts, seq, tenant_id, new_tenant_id, reason FROM judged WHERE reason IS NOT NULL", lambda f: H.apply_scd2(None, f, VERSIONED)["rejects"])
on_moves("audit_to_scd2_transfers", f"SELECT {', '.join(_VERSION)} FROM versions", lambda f: _rebuilt(A.apply_audited(None, f, AUDITED_SPEC)["audit"]).select(*_VERSION))
on_moves("scd2_to_audited_transfers", f"SELECT {AUDIT_COLUMNS} FROM audit", lambda f: M.scd2_to_audited(H.apply_scd2(None, f, VERSIONED)["table"], VERSIONED)["audit"].select(*_AUDIT))
on_moves("trail_round_trip_transfers", f"SELECT {AUDIT_COLUMNS} FROM audit", lambda f: M.scd2_to_audited(_rebuilt(A.apply_audited(None, f, AUDITED_SPEC)["audit"]), VERSIONED)["audit"].select(*_AUDIT))
on_moves("reconstruct_at_transfers", f"SELECT id, {USER}, owner AS tenant_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) AS rn FROM accepted WHERE change_ts <= {AT}) WHERE rn = 1 AND op <> 'delete'",
         lambda f: (lambda r: A.reconstruct_at(r["table"], r["audit"], NOW, AUDITED_SPEC, with_tenant=True))(A.apply_audited(None, f, AUDITED_SPEC, keep=lambda log: S.written(log, scratch(f.sparkSession, "log")))))


def _moved_in_batches(f: DataFrame) -> DataFrame:
    """Transfers on both sides of a cut between batches."""
    base = S.written(H.apply_scd2(None, f.where(F.col("change_ts") <= F.lit(NOW)), VERSIONED)["table"], scratch(f.sparkSession, "versions"))
    return H.apply_scd2(base, f.where(F.col("change_ts") > F.lit(NOW)), VERSIONED)["table"].select(*_VERSION)


on_moves("apply_scd2_transfers_batches", f"SELECT {', '.join(_VERSION)} FROM versions", _moved_in_batches)


def _late(f: DataFrame) -> DataFrame:
    """The later half first: what is then older than a record's last change is a reject, in a table without versions too."""
    base = U.apply_none(None, f.where(F.col("change_ts") > F.lit(NOW)).withColumn("op", F.when(F.col("rn") == 1, "create").otherwise("update")), CURRENT)["table"]
    return U.apply_none(base, f.where(F.col("change_ts") <= F.lit(NOW)), CURRENT)["rejects"].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


query("rejected_late", f"""SELECT CASE WHEN known THEN 'late' WHEN op = 'create' AND n > 1 THEN 'exists' WHEN NOT tenant_ok THEN 'wrong tenant' ELSE 'deleted' END AS reason, count(*) AS n
    FROM (SELECT j.*, k.id IS NOT NULL AS known, row_number() OVER (PARTITION BY j.id ORDER BY change_ts, seq) AS n FROM judged j LEFT JOIN (SELECT DISTINCT id FROM feed WHERE change_ts > {AT}) k ON j.id = k.id WHERE change_ts <= {AT})
    WHERE known OR reason IS NOT NULL GROUP BY 1""", chain=True)(lambda s, d: _late(feed(s, d).withColumn("rn", F.row_number().over(Window.partitionBy(F.col("change_ts") > F.lit(NOW), "id").orderBy("change_ts", "seq")))))  # fmt: skip

# Objects: the given tables' own bytes, stored as objects with side-cars by a first step.
def _store(s: SparkSession, d: str) -> str:
    """`part`'s names as objects, one file for each brand's parts; side-cars for some."""
    root = scratch(s, "store")
    parts = table(s, d, "part").select(F.regexp_replace("p_brand", "#", "-").alias("folder"), "p_name", "p_partkey")
    parts.orderBy("folder", "p_partkey").select("folder", F.concat_ws("|", "p_partkey", "p_name").alias("value")).repartition("folder").sortWithinPartitions("folder", F.substring_index("value", "|", 1).cast("long")).write.partitionBy("folder").text(f"{root}/objects")
    names = O.object_inventory(s, f"{root}/objects", limit=None).where("key like 'folder=%'").select("key")
    for key in (r["key"] for r in names.collect()):  # a file for each brand
        if not key.startswith("folder=Brand-1"):
            _put(s, f"{root}/objects/{key}{O.SIDE_CAR}", '{"brand": "%s", "by": "job"}' % key.split("/")[0].removeprefix("folder="))
    return f"{root}/objects"


def _put(s: SparkSession, path: str, text: str) -> None:
    at = s._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _folder() -> Column:
    return F.regexp_extract("key", "^folder=([^/]*)/", 1).alias("folder")


_OBJECTS = "WITH lines AS (SELECT replace(p_brand, '#', '-') AS folder, p_partkey, CAST(p_partkey AS VARCHAR) || '|' || p_name || chr(10) AS line FROM part), objects AS (SELECT folder, string_agg(line, '' ORDER BY p_partkey) AS body FROM lines GROUP BY folder) "
query("object_inventory", _OBJECTS + "SELECT folder, CAST(strlen(body) AS BIGINT) AS size FROM objects WHERE folder LIKE 'Brand-%'")(lambda s, d: O.object_inventory(s, _store(s, d), "folder=", limit=None).select(_folder(), "size"))
query("object_metadata", _OBJECTS + "SELECT folder, CASE WHEN folder NOT LIKE 'Brand-1%' THEN folder END AS brand, CASE WHEN folder NOT LIKE 'Brand-1%' THEN 2 ELSE 0 END AS entries FROM objects")(
    lambda s, d: O.object_metadata(s, _store(s, d)).where("key like 'folder=%'").select(_folder(), F.col("metadata")["brand"].alias("brand"), F.size("metadata").alias("entries"))
)
query("object_chunks", _OBJECTS + "SELECT folder, i AS chunk, md5(substr(body, i * 64 + 1, 64)) AS digest FROM (SELECT folder, body, unnest(range((strlen(body) + 63) // 64)) AS i FROM objects)")(
    lambda s, d: O.object_chunks(s, _store(s, d), 64, 1024).where("key like 'folder=%'").select(_folder(), F.col("chunk").cast("long").alias("chunk"), F.md5("bytes").alias("digest"))
)
on_table("object_key", "part", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'docs/' || p_brand END AS key FROM part", lambda t: t.select("p_partkey", keys.object_key(F.concat(F.when(F.col("p_size") % 3 == 0, "a/../../docs/").otherwise("//docs/"), "p_brand")).alias("key")))
on_table("metadata_keys", "part", "SELECT p_partkey, 'a_b_' || CAST(p_size AS VARCHAR) AS k, p_brand AS v FROM part", lambda t: t.select("p_partkey", F.explode(keys.metadata_keys(F.create_map(F.concat(F.lit("a-b."), F.col("p_size").cast("string")), "p_brand"))).alias("k", "v")))


# Writing, and streams.
def _written(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "written")
    S.write_table(table(s, d, "customer"), path)
    S.write_table(S.read_table(s, path).where("c_acctbal > 0"), path)
    return S.read_table(s, path)


def _appended(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "appended")
    for part in (table(s, d, "orders").where("o_orderstatus = 'O'"), table(s, d, "orders").where("o_orderstatus != 'O'")):
        S.bulk_write(part, path, ["o_orderstatus"])
    return S.read_table(s, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.countDistinct("o_custkey").alias("customers"))


def _pinned(s: SparkSession, d: str) -> DataFrame:
    """A reader that began before a partition was replaced, and one that began after it."""
    path = scratch(s, "pinned")
    S.write_table(table(s, d, "orders"), path, ["o_orderstatus"])
    before = S.read_table(s, path)
    S.write_table(before.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderstatus"], since=1)
    counts = lambda df, when: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_totalprice") == 0, 1)).alias("zero")).select(F.lit(when).alias("seen"), "*")
    return counts(before, "before").unionByName(counts(S.read_table(s, path), "after"))


def _through_a_database(s: SparkSession, d: str) -> DataFrame:
    """`customer` into a database in this process and back, in parts by the balance's quantiles; some balances are null, many the same."""
    url = f"jdbc:derby:memory:{scratch(s, 'db').rsplit('-', 1)[1]};create=true"
    c = table(s, d, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, None).when(F.col("c_custkey") % 3 == 0, 7.5).otherwise(F.col("c_acctbal")))
    S.write_jdbc(c, url, "customer", "overwrite")
    return S.read_jdbc_parts(s, url, "customer", '"c_acctbal"', 4).select("c_custkey", "c_name", "c_acctbal")


query("read_jdbc", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 7.5 ELSE c_acctbal END AS c_acctbal FROM customer")(_through_a_database)
query("read_snapshots", """SELECT 'before' AS seen, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice = 0) AS zero FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'after', o_orderstatus, count(*), CASE WHEN o_orderstatus = 'F' THEN count(*) ELSE count(*) FILTER (WHERE o_totalprice = 0) END FROM orders GROUP BY o_orderstatus""")(_pinned)
query("write_table", "SELECT * FROM customer WHERE c_acctbal > 0")(_written)
query("bulk_write", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")(_appended)


def _in_order(s: SparkSession, f: DataFrame, run: Callable[[DataFrame, str], None]) -> str:
    """Write a feed in two parts by time, each before a run of the stream over it."""
    path = scratch(s, "stream")
    for part in (f.where(F.col("change_ts") <= F.lit(NOW)), f.where(F.col("change_ts") > F.lit(NOW))):
        part.write.mode("append").parquet(f"{path}/in")
        run(s.readStream.schema(f.schema).parquet(f"{path}/in"), path)
    return path


def _streamed(s: SparkSession, d: str) -> DataFrame:
    path = _in_order(s, feed(s, d), lambda stream, p: R.stream_scd2(stream, f"{p}/table", f"{p}/state", VERSIONED, buckets=8).awaitTermination())
    return R.read_versions(s, f"{path}/table")


def _streamed_audit(s: SparkSession, d: str) -> DataFrame:
    path = _in_order(s, feed(s, d, days=True), lambda stream, p: R.stream_audit(stream, f"{p}/table", f"{p}/state", AUDITED_SPEC, buckets=8).awaitTermination())
    return R.read_audit(s, f"{path}/table").select(*_AUDIT)


def _delayed(s: SparkSession, d: str) -> DataFrame:
    """Transfers and all, over three runs: rows come up to 39 days late, so those of 40 days in any order; what may still be overtaken waits."""
    f, path, delay = moving_feed(s, d), scratch(s, "stream"), dt.timedelta(days=40)
    seconds = F.unix_seconds(F.col("change_ts").cast("timestamp"))
    first, last = f.agg(F.min(seconds), F.max(seconds)).first()
    since = seconds - F.lit(first) + F.pmod(F.crc32(F.col("seq").cast("string")), F.lit(delay.days)) * 86400
    run = F.coalesce(F.floor(since * 3 / F.lit((last or 0) - (first or 0) + delay.total_seconds())), F.lit(0))
    for k in range(3):
        f.where(run == k).write.mode("append").parquet(f"{path}/in")
        R.stream_table(s.readStream.schema(f.schema).parquet(f"{path}/in"), f"{path}/table", f"{path}/state", VERSIONED, delay=delay, buckets=8).awaitTermination()
    R.flush(s, f"{path}/table", VERSIONED, buckets=8)
    return R.read_versions(s, f"{path}/table").select(*_VERSION)


def _streamed_stats(s: SparkSession, d: str) -> DataFrame:
    """Every tenth row comes in a second run; of its windows most have closed by then. On-time windows, and the late rows by operation."""
    log = query_log(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = scratch(s, "stats")
    for part in (F.col("id") % 10 != 3, F.col("id") % 10 == 3):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = s.readStream.schema(log.schema).parquet(f"{path}/in")
        out = R.stream_query_stats(stream, "1 day").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        R.stream_late_rows(stream, f"{path}/late", f"{path}/late_state", "1 day").awaitTermination()
    windows = s.read.parquet(f"{path}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "operation", "total", "succeeded", "slow", "max_duration")
    late = R.read_late_rows(s, f"{path}/late").groupBy("operation").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("success"), 1)).alias("succeeded"), F.count(F.when(F.col("duration") > 1.0, 1)).alias("slow"), F.max("duration").alias("max_duration"))
    return windows.unionByName(late.withColumn("window_start", F.lit(None).cast("timestamp_ntz")))


query("stream_scd2", "SELECT * FROM versions", chain=True)(_streamed)
QUERIES["stream_audit"] = _streamed_audit
ORACLE_SQL["stream_audit"] = DAYS_SQL + f"SELECT {AUDIT_COLUMNS} FROM audit"
QUERIES["stream_transfers_delayed"] = _delayed
ORACLE_SQL["stream_transfers_delayed"] = MOVES_SQL + f"SELECT {', '.join(_VERSION)} FROM versions"
query("stream_query_stats", _LOG + """, t AS (SELECT *, date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end, id % 10 = 3 AS second FROM log),
    m AS (SELECT max("timestamp") FILTER (WHERE NOT second) - INTERVAL 10 MINUTE AS first_mark, max("timestamp") - INTERVAL 10 MINUTE AS last_mark FROM t),
    j AS (SELECT t.*, second AND window_end <= first_mark AS late, last_mark FROM t, m)
    SELECT window_start, operation, count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE duration > 1.0) AS slow, max(duration) AS max_duration FROM j WHERE NOT late AND window_end <= last_mark GROUP BY ALL
    UNION ALL SELECT NULL, operation, count(*), count(*) FILTER (WHERE success), count(*) FILTER (WHERE duration > 1.0), max(duration) FROM j WHERE late GROUP BY operation""")(_streamed_stats)  # fmt: skip


def entry(s: SparkSession, d: str) -> DataFrame:
    """Flagship: a feed becomes versions, the state at an instant is counted by type and tenant."""
    return P.as_of(versions(s, d), NOW).groupBy("event_type", "tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels"))


query("as_of_counts", f"SELECT event_type, tenant_id, count(*) AS n, CAST(sum(level) AS BIGINT) AS levels FROM versions WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) AND (deleted_at IS NULL OR deleted_at > {AT}) GROUP BY ALL", chain=True)(entry)
