"""Inputs derived from the given tables, written once in Spark and once in SQL.

These only shape the given tables into the schemas the operators expect
(a replica that differs, a change log, poll rows, ...). They do none of the
operators' work. Each Spark definition sits next to the SQL text the DuckDB
oracle uses for the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit.operators.fold import apply_changes
from replicakit.sources.tables import read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# change_log_k boundaries (staged change files)
PART_BOUNDARIES = ("2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00")
BASE_0_BEFORE = PART_BOUNDARIES[0]


def ts_ntz(s: str) -> Column:
    """A ``TIMESTAMP_NTZ`` literal (the given tables load as timestamp_ntz)."""
    return F.expr(f"TIMESTAMP_NTZ '{s}'")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------- orders_a/b
def orders_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders")


def orders_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kept = o.filter((F.col("o_orderdate") < ts_ntz("2001-01-01 00:00:00")) & (k % 97 != 0))
    kept = kept.withColumn(
        "o_totalprice",
        F.when(k % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copies = o.filter(k % 1000 == 1).withColumn("o_orderkey", -k)
    return kept.unionByName(copies)


ORDERS_B_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders
WHERE o_orderdate < TIMESTAMP '2001-01-01 00:00:00' AND o_orderkey % 97 <> 0
UNION ALL
SELECT -o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       o_orderpriority
FROM orders WHERE o_orderkey % 1000 = 1
"""


# -------------------------------------------------------------- change_log
CHANGE_KEYS = ["user_id"]
CHANGE_ORDER = ["ts", "event_id"]


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") == "error", F.lit("delete"))
        .otherwise(F.lit("upsert")).alias("op"),
        "event_type", "value",
    )


CHANGE_LOG_SQL = """
SELECT user_id, ts, event_id,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
       event_type, value
FROM events
"""


def change_part(ts: Column) -> Column:
    """1-based part of ``change_log_k`` a change falls in."""
    part = F.lit(len(PART_BOUNDARIES) + 1)
    for i, b in reversed(list(enumerate(PART_BOUNDARIES, start=1))):
        part = F.when(ts < ts_ntz(b), F.lit(i)).otherwise(part)
    return part


CHANGE_PART_SQL = ("CASE WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN 1 "
                   "WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 2 "
                   "WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 3 ELSE 4 END")


def change_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``change_log_k``: the change log cut at the part boundaries, in order."""
    log = change_log(spark, sf_dir).withColumn("_part", change_part(F.col("ts")))
    return [log.filter(F.col("_part") == i).drop("_part")
            for i in range(1, len(PART_BOUNDARIES) + 2)]


def stage(part: DataFrame, stage_dir: str) -> None:
    """Append one part's change files to the staging folder (written by as
    many tasks as the part has partitions)."""
    part.write.mode("append").parquet(stage_dir)


def base_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes before the first boundary, folded with deletes kept."""
    early = change_log(spark, sf_dir).filter(F.col("ts") < ts_ntz(BASE_0_BEFORE))
    return apply_changes(early, CHANGE_KEYS, CHANGE_ORDER, keep_deletes=True)


BASE_0_SQL = f"""
SELECT user_id, ts, event_id, op, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM ({CHANGE_LOG_SQL}) WHERE ts < TIMESTAMP '{BASE_0_BEFORE}') WHERE rn = 1
"""


# ------------------------------------------------------------------- polls
def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll rows per replica, in ``(ts, event_id)`` order (the try order)."""
    e = load(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("replica"),
        "ts", "event_id",
        F.when(F.col("event_type") == "view", F.lit("state replicating"))
        .otherwise(F.lit("state initializing")).alias("status_text"),
        F.when(F.col("value") > 50, F.lit("ready"))
        .otherwise(F.lit("add")).alias("data_state_text"),
    )


POLL_ORDER = ("ts", "event_id")

POLLS_SQL = """
SELECT user_id % 5 AS replica,
       CAST(rank() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS BIGINT) AS try_no,
       CASE WHEN event_type = 'view' THEN 'state replicating' ELSE 'state initializing' END
         AS status_text,
       CASE WHEN value > 50 THEN 'ready' ELSE 'add' END AS data_state_text
FROM events
"""


# -------------------------------------------------------------- inventories
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace inventory with one namespace per order (grows with data)."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("vc"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("ready"))
        .when(F.col("o_orderstatus") == "O", F.lit("replicating"))
        .otherwise(F.lit("add")).alias("data_state"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("shared"))
        .otherwise(F.lit("none")).alias("service_mode"),
    )


INVENTORY_SQL = """
SELECT o_orderkey AS id, 'vc' || CAST(o_orderkey AS VARCHAR) AS name,
       CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'replicating' ELSE 'add' END
         AS data_state,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'shared' ELSE 'none' END
         AS service_mode
FROM orders
"""


def requested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace names asked for, one per line item."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("vc"), F.col("l_orderkey").cast("string")).alias("name"),
                     "l_linenumber")


REQUESTED_NAMES_SQL = """
SELECT 'vc' || CAST(l_orderkey AS VARCHAR) AS name, l_linenumber FROM lineitem
"""


# ---------------------------------------------------------- texts and flags
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("row "), F.col("event_type"), F.lit(" / "),
                                         F.upper("event_type")).alias("status_text"))


STATUS_TEXT_SQL = """
SELECT event_id, 'row ' || event_type || ' / ' || upper(event_type) AS status_text FROM events
"""
STATUS_TEXT_VOCAB = ("error", "view", "click")


def table_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0,
               F.concat(F.lit("db_"), F.lower("c_mktsegment"), F.lit(".t"),
                        F.col("c_custkey").cast("string")))
        .otherwise(F.col("c_name")).alias("requested"),
    )


TABLE_REQUESTS_SQL = """
SELECT c_custkey,
       CASE WHEN c_acctbal >= 0
            THEN 'db_' || lower(c_mktsegment) || '.t' || CAST(c_custkey AS VARCHAR)
            ELSE c_name END AS requested
FROM customer
"""

FLAG_WORDS = ("1", "true", "YES", "On", "0", "no", "off", "maybe", " 1")


def flag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    expr = F.lit(None).cast("string")
    for i, w in reversed(list(enumerate(FLAG_WORDS))):
        expr = F.when(m == i, F.lit(w)).otherwise(expr)
    return e.select("event_id", expr.alias("flag_text"))


FLAG_TEXT_SQL = ("SELECT event_id, CASE event_id % 10 "
                 + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(FLAG_WORDS))
                 + " ELSE NULL END AS flag_text FROM events")


def control_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``(version, key, op, value)`` log: one key per user, values with ``=``."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("version"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", F.lit("del")).otherwise(F.lit("set")).alias("op"),
        F.concat(F.col("event_type"), F.lit("="), F.col("props")).alias("value"),
    )


CONTROL_LOG_SQL = """
SELECT event_id AS version, 'user.' || CAST(user_id AS VARCHAR) AS key,
       CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op,
       event_type || '=' || props AS value
FROM events
"""

POINTER_SIDES = ("primary", "A", "ca", "standby", "B", "cb", "other")
POINTER_TARGETS = {"click": "crla", "view": "vb-readonly", "purchase": "VA",
                   "signup": "crlb-readonly", "error": "Tenant9"}


def pointer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default-pointer history ``(side, target_namespace, version)`` in raw spellings."""
    e = load(spark, sf_dir, "events")
    m = F.col("user_id") % len(POINTER_SIDES)
    side = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(POINTER_SIDES))):
        side = F.when(m == i, F.lit(s)).otherwise(side)
    target = F.lit(None).cast("string")
    for k, v in POINTER_TARGETS.items():
        target = F.when(F.col("event_type") == k, F.lit(v)).otherwise(target)
    return e.select(side.alias("side"), target.alias("target_namespace"),
                    F.col("event_id").alias("version"))


POINTER_LOG_SQL = (
    "SELECT CASE user_id % 7 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(POINTER_SIDES))
    + " END AS side, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POINTER_TARGETS.items())
    + " END AS target_namespace, event_id AS version FROM events"
)


# ----------------------------------------------------------- nulls, seeds
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority")))


NULLS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders
"""


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to upsert: new status for existing keys, plus new keys."""
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 200 == 0)
    upd = o.select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    ins = o.select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"),
                   F.lit("X").alias("o_orderstatus"))
    return upd.unionByName(ins)


SEED_ROWS_SQL = """
SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 200 = 0
UNION ALL
SELECT o_orderkey + 10000000 AS o_orderkey, 'X' AS o_orderstatus FROM orders
WHERE o_orderkey % 200 = 0
"""


def with_fixtures(sql: str, **fixtures: str) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each fixture."""
    if not fixtures:
        return sql
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in fixtures.items())
    return f"WITH {ctes}\n{sql}"
