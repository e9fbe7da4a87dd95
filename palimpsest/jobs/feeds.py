"""The given tables as the inputs of the record-keeping jobs, in DataFrames and in SQL.

`events` is a change feed of about ten records a user: the first row of a record creates it, errors
of more than 20 delete it, a few rows come from a wrong tenant, clicks set the level only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.audit import apply_audited
from ..operators.current import apply_none
from ..operators.scd2 import apply_scd2
from ..sources.tables import written
from ..spec import AUDITED, NONE, SCD2, TableSpec

FIELDS = ("event_type", "level", "props")
#: Rows of a feed that one task sorts, about: its memory doesn't grow with the table.
TASK_ROWS = 250_000
VERSIONED = TableSpec("activity", FIELDS, SCD2)
AUDITED_SPEC = TableSpec("activity", FIELDS, AUDITED)
CURRENT = TableSpec("activity", FIELDS, NONE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, n_rows: int, key: str = "id") -> DataFrame:
    """Rows by their record, in as many partitions as TASK_ROWS asks for where that's more than one; windows on the record shuffle them no more."""
    if n_rows <= TASK_ROWS:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS)), key)


def feed(spark: SparkSession, sf_dir: str, days: bool = False) -> DataFrame:
    """The feed; days cuts the instants to days, so that many changes of a record have the same one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts") if days else F.col("ts"), "event_type", "value", "props")
    rid = (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string")
    first = F.row_number().over(Window.partitionBy("id").orderBy("ts", "event_id")) == 1
    op = F.when(first, "create").when((F.col("event_type") == "error") & (F.col("value") > 20), "delete").when((F.col("event_type") == "signup") & (F.col("value") > 60), "create").otherwise("update")
    return dealt(e.withColumn("id", rid), e.count()).select(
        "id", op.alias("op"), F.col("ts").alias("change_ts"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 5 + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)).cast("string").alias("tenant_id"), (F.col("event_id") % 7).cast("string").alias("user_id"),
        "event_type", F.floor(F.col("value") / 20).cast("long").alias("level"), "props", F.when(F.col("event_type") == "click", F.array(F.lit("level"))).alias("set_fields"),
    )


def moving_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with transfers among its rows: two tenants and a wrong one; every sixth row asks for a transfer, some of them for no tenant, some without naming the owner."""
    f = feed(spark, sf_dir)
    asks = (F.col("op") == "update") & (F.col("seq") % 6 == 1)
    claimed = (F.floor(F.col("id").cast("long") / 10) % 2 + F.when(F.col("seq") % 50 == 7, 2).otherwise(0)).cast("string")
    return f.withColumns({
        "op": F.when(asks, "transfer").otherwise(F.col("op")),
        "new_tenant_id": F.when(asks & (F.col("seq") % 35 != 1), (F.col("seq") % 3).cast("string")),
        "tenant_id": F.when(~asks | (F.col("seq") % 4 != 1), claimed),
    })


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_scd2(None, feed(spark, sf_dir), VERSIONED)["table"]


def audited(spark: SparkSession, sf_dir: str, days: bool = False, spec: TableSpec = AUDITED_SPEC) -> dict[str, DataFrame]:
    return apply_audited(None, feed(spark, sf_dir, days), spec)


def audited_once(spark: SparkSession, sf_dir: str, days: bool = False, spec: TableSpec = AUDITED_SPEC) -> dict[str, DataFrame]:
    """As audited, for who reads both table and audit: the change log is written, and read for each."""
    return apply_audited(None, feed(spark, sf_dir, days), spec, keep=lambda log: written(log, scratch(spark, "log")))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_none(None, feed(spark, sf_dir), CURRENT)["table"]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a log of queries: the type is the operation, the value its duration, errors failed."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("success"))


#: Common table expressions for the oracle: feed, judged, accepted, kept, versions, audit, current_state.
CHAIN_SQL = """
WITH raw AS (
    SELECT CAST(user_id * 10 + event_id % 10 AS VARCHAR) AS id, ts AS change_ts, event_id AS seq,
           CAST(user_id % 5 + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS VARCHAR) AS tenant_id, CAST(event_id % 7 AS VARCHAR) AS user_id,
           event_type, value, CAST(floor(value / 20) AS BIGINT) AS level, props
    FROM events
), feed AS (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY change_ts, seq) = 1 THEN 'create'
                   WHEN event_type = 'error' AND value > 20 THEN 'delete' WHEN event_type = 'signup' AND value > 60 THEN 'create' ELSE 'update' END AS op
    FROM raw
), flagged AS (
    SELECT *, row_number() OVER w > 1 AS found, tenant_id = first_value(tenant_id) OVER w AS tenant_ok FROM feed WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), judged AS (
    SELECT *, CASE WHEN op = 'create' THEN CASE WHEN found THEN 'exists' END WHEN NOT tenant_ok THEN 'wrong tenant' WHEN dead THEN 'deleted' END AS reason
    FROM (SELECT *, coalesce(bool_or(found AND tenant_ok AND op = 'delete') OVER (PARTITION BY id ORDER BY change_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM flagged)
), states AS (
    SELECT id, op, change_ts, seq, tenant_id, user_id,
           last_value(CASE WHEN op = 'create' OR op = 'update' AND event_type <> 'click' THEN event_type END IGNORE NULLS) OVER w AS event_type,
           last_value(CASE WHEN op IN ('create', 'update') THEN level END IGNORE NULLS) OVER w AS level,
           last_value(CASE WHEN op = 'create' OR op = 'update' AND event_type <> 'click' THEN props END IGNORE NULLS) OVER w AS props
    FROM judged WHERE reason IS NULL WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), accepted AS MATERIALIZED (
    SELECT *, lag(event_type) OVER w AS old_event_type, lag(level) OVER w AS old_level, lag(props) OVER w AS old_props FROM states WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), kept AS (
    SELECT * FROM accepted WHERE op IN ('create', 'delete') OR event_type <> old_event_type OR level <> old_level OR props <> old_props
), versions AS (
    SELECT id, event_type, level, props, first_value(change_ts) OVER w AS created_at, change_ts AS updated_at, first_value(user_id) OVER w AS created_by,
           last_value(CASE WHEN op = 'update' THEN user_id END IGNORE NULLS) OVER w AS updated_by, first_value(tenant_id) OVER w AS tenant_id,
           CASE WHEN op = 'delete' THEN change_ts END AS deleted_at, CASE WHEN op = 'delete' THEN user_id END AS deleted_by,
           change_ts AS valid_from, lead(change_ts) OVER w AS valid_to, CAST(row_number() OVER w AS INTEGER) AS version
    FROM kept WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), managed AS (
    SELECT id, event_type, level, props, first_value(change_ts) OVER w AS created_at, last_value(CASE WHEN op <> 'delete' THEN change_ts END IGNORE NULLS) OVER w AS updated_at,
           first_value(user_id) OVER w AS created_by, last_value(CASE WHEN op = 'update' THEN user_id END IGNORE NULLS) OVER w AS updated_by, first_value(tenant_id) OVER w AS tenant_id,
           CASE WHEN op = 'delete' THEN change_ts END AS deleted_at, CASE WHEN op = 'delete' THEN user_id END AS deleted_by,
           row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) AS rn
    FROM accepted WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), current_state AS (
    SELECT * EXCLUDE (rn) FROM managed WHERE rn = 1
), encoded AS (
    SELECT *, '"' || event_type || '"' AS j_type, CAST(level AS VARCHAR) AS j_level, '"' || replace(props, '"', '\\"') || '"' AS j_props,
           '"' || old_event_type || '"' AS o_type, CAST(old_level AS VARCHAR) AS o_level, '"' || replace(old_props, '"', '\\"') || '"' AS o_props
    FROM accepted
), entries AS (
    SELECT id, op, change_ts, seq, user_id, 'event_type' AS field_name, o_type AS old_value, j_type AS new_value, event_type IS DISTINCT FROM old_event_type AS differs FROM encoded
    UNION ALL SELECT id, op, change_ts, seq, user_id, 'level', o_level, j_level, level IS DISTINCT FROM old_level FROM encoded
    UNION ALL SELECT id, op, change_ts, seq, user_id, 'props', o_props, j_props, props IS DISTINCT FROM old_props FROM encoded
), owners AS (
    SELECT id, tenant_id AS owner FROM accepted WHERE op = 'create'
), audit AS MATERIALIZED (
    SELECT id AS record_id, owner AS tenant_id, field_name, CASE WHEN op = 'update' THEN old_value END AS old_value, new_value, CASE op WHEN 'create' THEN 'INSERT' ELSE 'UPDATE' END AS operation, change_ts AS changed_at, user_id AS changed_by, seq
    FROM entries JOIN owners USING (id) WHERE op = 'create' OR op = 'update' AND differs
    UNION ALL SELECT id, owner, 'deleted_at', NULL,
           '"' || CASE WHEN CAST(date_part('microseconds', change_ts) AS BIGINT) % 1000000 = 0 THEN strftime(change_ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(change_ts, '%Y-%m-%dT%H:%M:%S.%f') END || '"', 'DELETE', change_ts, user_id, seq
    FROM accepted JOIN owners USING (id) WHERE op = 'delete'
)
"""

#: The same over the feed with instants cut to days.
DAYS_SQL = CHAIN_SQL.replace("ts AS change_ts", "date_trunc('day', ts) AS change_ts")


#: The same over the feed with transfers: acceptance row by row, from the owner and the deletion so far.
MOVES_SQL = (
    CHAIN_SQL[: CHAIN_SQL.index("), flagged AS")].replace("WITH raw", "WITH RECURSIVE raw")
    + """
), numbered AS MATERIALIZED (
    SELECT * EXCLUDE (op, tenant_id), CASE WHEN asks THEN 'transfer' ELSE op END AS op, CASE WHEN asks AND seq % 35 <> 1 THEN CAST(seq % 3 AS VARCHAR) END AS new_tenant_id,
           CASE WHEN NOT asks OR seq % 4 <> 1 THEN CAST(CAST(id AS BIGINT) // 10 % 2 + CASE WHEN seq % 50 = 7 THEN 2 ELSE 0 END AS VARCHAR) END AS tenant_id,
           row_number() OVER (PARTITION BY id ORDER BY change_ts, seq) AS n
    FROM (SELECT *, op = 'update' AND seq % 6 = 1 AS asks FROM feed)
), fold AS (
    SELECT id, n, tenant_id AS owner, CAST(NULL AS VARCHAR) AS old_owner, false AS dead, CAST(NULL AS VARCHAR) AS reason FROM numbered WHERE n = 1
    UNION ALL
    SELECT id, n, CASE WHEN reason IS NULL AND op = 'transfer' THEN new_tenant_id ELSE owner END, owner, dead OR (reason IS NULL AND op = 'delete'), reason
    FROM (SELECT b.id, b.n, b.op, b.new_tenant_id, f.owner, f.dead,
                 CASE WHEN b.op = 'create' THEN 'exists'
                      WHEN b.op = 'transfer' THEN CASE WHEN b.new_tenant_id IS NULL THEN 'no tenant' WHEN b.tenant_id <> f.owner THEN 'wrong tenant' WHEN f.dead THEN 'deleted' WHEN b.new_tenant_id = f.owner THEN 'same tenant' END
                      WHEN b.tenant_id <> f.owner THEN 'wrong tenant' WHEN f.dead THEN 'deleted' END AS reason
          FROM fold f JOIN numbered b ON b.id = f.id AND b.n = f.n + 1)
), judged AS MATERIALIZED (
    SELECT numbered.*, owner, old_owner, reason FROM fold JOIN numbered USING (id, n)
), states AS (
    SELECT id, op, change_ts, seq, owner, old_owner, user_id,
           last_value(CASE WHEN op = 'create' OR op = 'update' AND event_type <> 'click' THEN event_type END IGNORE NULLS) OVER w AS event_type,
           last_value(CASE WHEN op IN ('create', 'update') THEN level END IGNORE NULLS) OVER w AS level,
           last_value(CASE WHEN op = 'create' OR op = 'update' AND event_type <> 'click' THEN props END IGNORE NULLS) OVER w AS props
    FROM judged WHERE reason IS NULL WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), accepted AS MATERIALIZED (
    SELECT *, lag(event_type) OVER w AS old_event_type, lag(level) OVER w AS old_level, lag(props) OVER w AS old_props FROM states WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), versions AS (
    SELECT id, event_type, level, props, owner AS tenant_id, change_ts AS valid_from, lead(change_ts) OVER w AS valid_to, CAST(row_number() OVER w AS INTEGER) AS version,
           last_value(CASE WHEN op IN ('update', 'transfer') THEN user_id END IGNORE NULLS) OVER w AS updated_by, CASE WHEN op = 'delete' THEN change_ts END AS deleted_at
    FROM accepted WHERE op <> 'update' OR event_type <> old_event_type OR level <> old_level OR props <> old_props WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq)
), current_state AS (
    SELECT id, event_type, level, props, owner AS tenant_id, last_value(CASE WHEN op <> 'delete' THEN change_ts END IGNORE NULLS) OVER w AS updated_at,
           last_value(CASE WHEN op IN ('update', 'transfer') THEN user_id END IGNORE NULLS) OVER w AS updated_by, CASE WHEN op = 'delete' THEN change_ts END AS deleted_at
    FROM accepted WINDOW w AS (PARTITION BY id ORDER BY change_ts, seq) QUALIFY row_number() OVER (PARTITION BY id ORDER BY change_ts DESC, seq DESC) = 1
), entries AS (
    SELECT *, 'event_type' AS field_name, '"' || old_event_type || '"' AS old_value, '"' || event_type || '"' AS new_value, event_type IS DISTINCT FROM old_event_type AS differs FROM accepted
    UNION ALL SELECT *, 'level', CAST(old_level AS VARCHAR), CAST(level AS VARCHAR), level IS DISTINCT FROM old_level FROM accepted
    UNION ALL SELECT *, 'props', '"' || replace(old_props, '"', '\\"') || '"', '"' || replace(props, '"', '\\"') || '"', props IS DISTINCT FROM old_props FROM accepted
), audit AS MATERIALIZED (
    SELECT id AS record_id, owner AS tenant_id, field_name, CASE WHEN op = 'update' THEN old_value END AS old_value, new_value, CASE op WHEN 'create' THEN 'INSERT' ELSE 'UPDATE' END AS operation, change_ts AS changed_at, user_id AS changed_by
    FROM entries WHERE op = 'create' OR op = 'update' AND differs
    UNION ALL SELECT id, owner, 'tenant_id', '"' || old_owner || '"', '"' || owner || '"', 'TRANSFER', change_ts, user_id FROM accepted WHERE op = 'transfer'
    UNION ALL SELECT id, owner, 'deleted_at', NULL,
           '"' || CASE WHEN CAST(date_part('microseconds', change_ts) AS BIGINT) % 1000000 = 0 THEN strftime(change_ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(change_ts, '%Y-%m-%dT%H:%M:%S.%f') END || '"', 'DELETE', change_ts, user_id
    FROM accepted WHERE op = 'delete'
)
"""
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for queries that write tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{named or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints'}/{name}-{uuid.uuid4().hex}"
