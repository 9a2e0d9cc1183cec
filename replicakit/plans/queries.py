"""Registered queries: one per operator, each over the given tables.

Every query reads whole given tables (or data Spark derives from them) and
returns a DataFrame; :data:`ORACLE_SQL` holds the DuckDB SQL that computes the
same rows on the same Parquet files. Column names agree on both sides.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicakit import fixtures as fx
from replicakit.constants import DEFAULT_TABLE, REPL_ATOB_ACTIVE, REPL_BTOA_ACTIVE, SIDE_A, SIDE_B
from replicakit.functions.text import (
    canon_side_col,
    checked_table_name,
    first_token,
    is_true,
    map_namespace_col,
)
from replicakit.operators.counts import (
    compare_counts,
    count_with_fallback,
    count_with_guard,
    row_count,
    row_counts,
)
from replicakit.operators.diff import apply_diff, resync_diff
from replicakit.operators.fold import apply_changes, control_state
from replicakit.operators.integrity import check_not_null, check_unique
from replicakit.operators.inventory import is_in_mode, namespaces_in_mode, state_of
from replicakit.operators.keyed import KeyedTable, depth_for, keyed_diff, store_keyed
from replicakit.operators.upsert import fill_defaults, upsert
from replicakit.plans.replica import ChangeSpec, initial_copy, read_batches, readonly_view
from replicakit.plans.replication import Replication, load, remove, restart_replication
from replicakit.plans.scenario import create_sides, run_scenario, smoke
from replicakit.plans.status import health_report, ready_gate, replication_status
from replicakit.session import scratch_path
from replicakit.sources.registry import (
    Registry,
    create_if_absent,
    pointer_table,
    pointers,
    read_side,
    resolve_default,
    run_sql,
    swap_default,
    table_inventory,
)
from replicakit.streaming.heartbeat import Heartbeat, recorded_word, stream_key
from replicakit.streaming.replicate import replicate_stream
from replicakit.streaming.watch import watch_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ORDER_KEYS = ["o_orderkey"]
SIDES = (SIDE_A, SIDE_B)


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def given_registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Side A / ``va`` holds every given table; side B / ``vb`` holds the replica
    ``orders_b`` and the given ``lineitem``."""
    reg = Registry(spark, scratch_path(spark, "registry"))
    for t in fx.TABLES:
        reg.mount("A", "va", t, f"{sf_dir.rstrip('/')}/{t}.parquet")
    reg.mount("B", "vb", "orders", lambda: fx.orders_b(spark, sf_dir))
    reg.mount("B", "vb", "lineitem", f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return reg


def pointer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer log of the events as control rows."""
    return fx.pointer_log(spark, sf_dir).select(
        F.col("version"),
        F.concat(F.lit("default/"), canon_side_col("side")).alias("key"),
        F.lit("set").alias("op"),
        map_namespace_col("target_namespace").alias("value"),
    ).filter(F.col("key").isNotNull())


# ------------------------------------------------------------------ counts
@register("row_count", """
SELECT 'CA' AS side, 'orders' AS table_name, count(*) AS n_rows FROM orders
""")
def q_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(spark, given_registry(spark, sf_dir), "primary", "orders")


@register("row_counts", fx.with_fixtures("""
SELECT 'CB' AS side, 'orders' AS table_name, count(*) AS n_rows FROM orders_b
UNION ALL SELECT 'CB', 'lineitem', count(*) FROM lineitem
""", orders_b=fx.ORDERS_B_SQL))
def q_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts(spark, given_registry(spark, sf_dir), "standby", ["orders", "lineitem"])


COMPARE_COUNTS_SQL = fx.with_fixtures("""
SELECT coalesce(a.table_name, b.table_name) AS table_name, a.n_rows AS n_a, b.n_rows AS n_b,
       CASE WHEN a.n_rows IS NULL OR b.n_rows IS NULL THEN 'waiting'
            WHEN a.n_rows = b.n_rows THEN 'match' ELSE 'mismatch' END AS verdict
FROM ca a FULL OUTER JOIN cb b ON a.table_name = b.table_name
""", orders_b=fx.ORDERS_B_SQL, ca="""
SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'customer', count(*) FROM customer""", cb="""
SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders_b
UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")


@register("compare_counts", COMPARE_COUNTS_SQL)
def q_compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do both sides agree? Counts on A and B, joined per table."""
    reg = given_registry(spark, sf_dir)
    a = row_counts(spark, reg, "A", ["orders", "lineitem", "customer"])
    b = row_counts(spark, reg, "B", ["orders", "lineitem"])
    return compare_counts(a, b)


# ---------------------------------------------------------- inventory (O10-12)
@register("namespaces_in_mode", fx.with_fixtures(
    "SELECT name FROM inv WHERE service_mode = 'shared'", inv=fx.INVENTORY_SQL))
def q_namespaces_in_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namespaces_in_mode(fx.inventory_rows(spark, sf_dir), "shared")


NAMESPACE_ALIAS_SQL = """CASE WHEN lower({c}) = 'crla' THEN 'va'
              WHEN lower({c}) = 'crlb' THEN 'vb'
              WHEN lower({c}) = 'crla-readonly' THEN 'va-readonly'
              WHEN lower({c}) = 'crlb-readonly' THEN 'vb-readonly'
              WHEN lower({c}) IN ('va', 'vb', 'va-readonly', 'vb-readonly', 'system')
                THEN lower({c})
              ELSE {c} END"""


@register("is_in_mode", fx.with_fixtures(f"""
SELECT r.name, r.l_linenumber,
       ({NAMESPACE_ALIAS_SQL.format(c="r.name")})
         IN (SELECT name FROM inv WHERE service_mode = 'shared') AS in_mode
FROM req r
""", inv=fx.INVENTORY_SQL, req=fx.REQUESTED_NAMES_SQL))
def q_is_in_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return is_in_mode(fx.requested_names(spark, sf_dir), fx.inventory_rows(spark, sf_dir), "shared")


@register("state_of", fx.with_fixtures(
    "SELECT name, data_state FROM inv WHERE name = 'vc7'", inv=fx.INVENTORY_SQL))
def q_state_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(fx.inventory_rows(spark, sf_dir), "vc7")


# ------------------------------------------------------------ texts (O13-14)
@register("first_token", fx.with_fixtures("""
SELECT event_id, nullif(regexp_extract(lower(status_text), '(error|click|view)', 1), '') AS token
FROM st
""", st=fx.STATUS_TEXT_SQL))
def q_first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = fx.status_text(spark, sf_dir)
    return st.select("event_id", first_token("status_text", fx.STATUS_TEXT_VOCAB).alias("token"))


@register("checked_table_name", fx.with_fixtures("""
SELECT c_custkey,
       CASE WHEN regexp_full_match(requested, '[A-Za-z0-9_.]+') THEN requested
            ELSE 'movr.users' END AS table_name
FROM req
""", req=fx.TABLE_REQUESTS_SQL))
def q_checked_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = fx.table_requests(spark, sf_dir)
    return req.select("c_custkey",
                      checked_table_name("requested", DEFAULT_TABLE).alias("table_name"))


# --------------------------------------------------------- integrity (O19-20)
@register("check_not_null", fx.with_fixtures("""
SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_nulls FROM n
UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM n
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL) FROM n
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL) FROM n
UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM n
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL) FROM n
""", n=fx.NULLS_SQL))
def q_check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_not_null(fx.nulls(spark, sf_dir))


@register("check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def q_check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_unique(fx.load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------- fold
APPLY_CHANGES_SQL = fx.with_fixtures("""
SELECT user_id, ts, event_id, op, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM cl) WHERE rn = 1 AND op <> 'delete'
""", cl=fx.CHANGE_LOG_SQL)


@register("apply_changes", APPLY_CHANGES_SQL)
def q_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(fx.change_log(spark, sf_dir), fx.CHANGE_KEYS, fx.CHANGE_ORDER)


@register("control_state", fx.with_fixtures("""
SELECT key, value, version FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM cl)
WHERE rn = 1 AND op <> 'del'
""", cl=fx.CONTROL_LOG_SQL))
def q_control_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_state(fx.control_log_rows(spark, sf_dir))


@register("is_true", fx.with_fixtures("""
SELECT event_id, flag_text, coalesce(lower(flag_text) IN ('1', 'true', 'yes', 'on'), false) AS flag
FROM ft
""", ft=fx.FLAG_TEXT_SQL))
def q_is_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = fx.flag_text(spark, sf_dir)
    return ft.select("event_id", "flag_text", is_true("flag_text").alias("flag"))


# ------------------------------------------------------ pointers (O1, O2)
@register("pointer_table", fx.with_fixtures("""
SELECT side, max_by(target_namespace, version) AS target_namespace, max(version) AS version
FROM (
  SELECT CASE WHEN lower(side) IN ('ca', 'a', '1', 'primary', 'p') THEN 'CA'
              WHEN lower(side) IN ('cb', 'b', '2', 'standby', 's') THEN 'CB' END AS side,
         CASE WHEN lower(target_namespace) = 'crla' THEN 'va'
              WHEN lower(target_namespace) = 'crlb' THEN 'vb'
              WHEN lower(target_namespace) = 'crla-readonly' THEN 'va-readonly'
              WHEN lower(target_namespace) = 'crlb-readonly' THEN 'vb-readonly'
              WHEN lower(target_namespace) IN ('va', 'vb', 'va-readonly', 'vb-readonly', 'system')
                THEN lower(target_namespace)
              ELSE target_namespace END AS target_namespace,
         version
  FROM pl) WHERE side IS NOT NULL
GROUP BY side
""", pl=fx.POINTER_LOG_SQL))
def q_pointer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointer_table(fx.pointer_log(spark, sf_dir))


RESOLVE_DEFAULT_SQL = fx.with_fixtures("""
SELECT s.side, coalesce(max_by(ns, version), s.main) AS target_namespace
FROM (VALUES ('CA', 'va'), ('CB', 'vb')) AS s(side, main) LEFT JOIN (
  SELECT CASE WHEN lower(side) IN ('ca', 'a', '1', 'primary', 'p') THEN 'CA'
              WHEN lower(side) IN ('cb', 'b', '2', 'standby', 's') THEN 'CB' END AS side,
         CASE WHEN lower(target_namespace) = 'crla' THEN 'va'
              WHEN lower(target_namespace) = 'crlb' THEN 'vb'
              WHEN lower(target_namespace) = 'crla-readonly' THEN 'va-readonly'
              WHEN lower(target_namespace) = 'crlb-readonly' THEN 'vb-readonly'
              WHEN lower(target_namespace) IN ('va', 'vb', 'va-readonly', 'vb-readonly', 'system')
                THEN lower(target_namespace)
              ELSE target_namespace END AS ns, version
  FROM pl) p ON p.side = s.side
GROUP BY s.side, s.main
""", pl=fx.POINTER_LOG_SQL)


@register("resolve_default", RESOLVE_DEFAULT_SQL)
def q_resolve_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The namespace each side's unqualified reads reach, after an imported history."""
    reg = given_registry(spark, sf_dir)
    reg.import_control(pointer_history(spark, sf_dir))
    return spark.createDataFrame([(s, resolve_default(reg, s)) for s in SIDES],
                                 "side string, target_namespace string")


# --------------------------------------------------------------- diff (O22-23)
RESYNC_DIFF_SQL = fx.with_fixtures("""
SELECT coalesce(s.o_orderkey, r.o_orderkey) AS o_orderkey,
       CASE WHEN r.o_orderkey IS NULL THEN 'insert'
            WHEN s.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS action,
       s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, s.o_orderpriority
FROM orders s FULL OUTER JOIN orders_b r ON s.o_orderkey = r.o_orderkey
WHERE r.o_orderkey IS NULL OR s.o_orderkey IS NULL
   OR s.o_custkey IS DISTINCT FROM r.o_custkey
   OR s.o_orderstatus IS DISTINCT FROM r.o_orderstatus
   OR s.o_totalprice IS DISTINCT FROM r.o_totalprice
   OR s.o_orderdate IS DISTINCT FROM r.o_orderdate
   OR s.o_orderpriority IS DISTINCT FROM r.o_orderpriority
""", orders_b=fx.ORDERS_B_SQL)


@register("resync_diff", RESYNC_DIFF_SQL)
def q_resync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync_diff(fx.orders_a(spark, sf_dir), fx.orders_b(spark, sf_dir), ORDER_KEYS)


@lru_cache(maxsize=4)
def _stored_orders(spark: SparkSession, sf_dir: str) -> tuple[KeyedTable, KeyedTable]:
    """Both sides of the orders stored by key bucket, as a registry stores a version when it
    writes it; once per session and folder."""
    tables = []
    for name, make in (("orders-a", fx.orders_a), ("orders-b", fx.orders_b)):
        rows, path = make(spark, sf_dir), scratch_path(spark, name)
        tables.append(KeyedTable(f"{path}/rows", f"{path}/digests", depth_for(rows.count(), PRUNED_BUCKET_ROWS)))
        store_keyed(rows, ORDER_KEYS, tables[-1])
    return tables[0], tables[1]


#: Rows of a key bucket in the registered query, about (the given tables are small).
PRUNED_BUCKET_ROWS = 5000


@register("resync_diff_pruned", RESYNC_DIFF_SQL)
def q_resync_diff_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same diff of the sides as stored: digest trees first, then the files of changed buckets."""
    return keyed_diff(spark, *_stored_orders(spark, sf_dir), ORDER_KEYS)


@register("apply_diff", "SELECT * FROM orders")
def q_apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, rep = fx.orders_a(spark, sf_dir), fx.orders_b(spark, sf_dir)
    return apply_diff(rep, resync_diff(src, rep, ORDER_KEYS), ORDER_KEYS)


# ------------------------------------------------------------- upsert (O7-8)
@register("upsert", fx.with_fixtures("""
SELECT coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN NULL ELSE b.o_custkey END AS o_custkey,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE b.o_orderstatus END
         AS o_orderstatus,
       b.o_totalprice, b.o_orderdate,
       CASE WHEN b.o_orderkey IS NULL THEN '3-MEDIUM' ELSE b.o_orderpriority END
         AS o_orderpriority
FROM orders b FULL OUTER JOIN seed s ON b.o_orderkey = s.o_orderkey
""", seed=fx.SEED_ROWS_SQL))
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(fx.orders_a(spark, sf_dir), fx.seed_rows(spark, sf_dir), ORDER_KEYS,
                  defaults={"o_orderpriority": "3-MEDIUM"})


@register("fill_defaults", fx.with_fixtures("""
SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, o_orderstatus,
       CAST(0.0 AS DOUBLE) AS o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate,
       '3-MEDIUM' AS o_orderpriority
FROM seed
""", seed=fx.SEED_ROWS_SQL))
def q_fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.orders_a(spark, sf_dir).schema
    return fill_defaults(fx.seed_rows(spark, sf_dir),
                         {"o_orderpriority": "3-MEDIUM", "o_totalprice": 0.0}, schema)


# ------------------------------------------------- registry
@register("read_side", "SELECT * FROM orders")
def q_read_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side spelled ``primary``, namespace by its old alias ``CRLA``."""
    return read_side(spark, given_registry(spark, sf_dir), "primary", "CRLA", "orders")


# The swaps the reference tool makes, in order: create A, create B, failover
# A->B, start B->A, failover B->A, restart A->B.
SWAP_SEQUENCE = (("A", "va"), ("B", "vb-readonly"), ("B", "vb"), ("B", "vb"),
                 ("A", "va-readonly"), ("A", "va"), ("B", "vb"), ("A", "va"),
                 ("B", "vb-readonly"))

SWAP_DEFAULT_SQL = fx.with_fixtures("""
SELECT substr(key, 9) AS side, max_by(value, version) AS target_namespace
FROM log WHERE key LIKE 'default/%' GROUP BY key
""", pl=fx.POINTER_LOG_SQL, log="""
SELECT version, 'default/' || side AS key, target_namespace AS value FROM (
  SELECT CASE WHEN lower(side) IN ('ca', 'a', '1', 'primary', 'p') THEN 'CA'
              WHEN lower(side) IN ('cb', 'b', '2', 'standby', 's') THEN 'CB' END AS side,
         CASE WHEN lower(target_namespace) = 'crla' THEN 'va'
              WHEN lower(target_namespace) = 'crlb' THEN 'vb'
              WHEN lower(target_namespace) = 'crla-readonly' THEN 'va-readonly'
              WHEN lower(target_namespace) = 'crlb-readonly' THEN 'vb-readonly'
              WHEN lower(target_namespace) IN ('va', 'vb', 'va-readonly', 'vb-readonly', 'system')
                THEN lower(target_namespace)
              ELSE target_namespace END AS target_namespace, version
  FROM pl) WHERE side IS NOT NULL
UNION ALL
SELECT 1000000000000 + n AS version, 'default/' || s AS key, ns AS value FROM (VALUES """
    + ", ".join(f"({i}, 'C{s}', '{ns}')" for i, (s, ns) in enumerate(SWAP_SEQUENCE))
    + ") AS t(n, s, ns)")


@register("swap_default", SWAP_DEFAULT_SQL)
def q_swap_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer history imported from the events, then the tool's swaps."""
    reg = given_registry(spark, sf_dir)
    reg.import_control(pointer_history(spark, sf_dir))
    for side, ns in SWAP_SEQUENCE:
        swap_default(reg, side, ns)
    return pointers(reg)


RUN_SQL_TEXT = """
SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS n_orders, max(o.o_totalprice) AS max_price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment, o.o_orderstatus
"""


@register("run_sql", RUN_SQL_TEXT)
def q_run_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, given_registry(spark, sf_dir), RUN_SQL_TEXT, side="a")


@register("table_inventory", "\nUNION ALL ".join(
    f"SELECT 'va' AS namespace, '{t}' AS table_name, count(*) AS n_rows FROM {t}"
    for t in sorted(fx.TABLES)))
def q_table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_inventory(spark, given_registry(spark, sf_dir), "A", "va")


@register("create_if_absent", "SELECT * FROM orders")
def q_create_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, fill, create again (a no-op), read back."""
    reg = given_registry(spark, sf_dir)
    orders = fx.orders_a(spark, sf_dir)
    create_if_absent(spark, reg, "B", "vb", "orders_copy", orders.schema)
    reg.write_version("B", "vb", "orders_copy", orders)
    create_if_absent(spark, reg, "B", "vb", "orders_copy", orders.schema)
    return reg.read("B", "vb", "orders_copy")


@register("smoke", "SELECT 'CA' AS side, true AS ok UNION ALL SELECT 'CB' AS side, true AS ok")
def q_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoke(spark, given_registry(spark, sf_dir))


# ----------------------------------------------------- fallbacks
@register("count_with_fallback", fx.with_fixtures("""
SELECT 'orders' AS table_name, 'vb' AS served_by, count(*) AS n_rows FROM orders_b
UNION ALL SELECT 'lineitem', 'vb', count(*) FROM lineitem
UNION ALL SELECT 'customer', NULL, NULL
""", orders_b=fx.ORDERS_B_SQL))
def q_count_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred ``vb-readonly`` does not exist on B; ``customer`` nowhere."""
    return count_with_fallback(spark, given_registry(spark, sf_dir), "B",
                               ["orders", "lineitem", "customer"], "vb-readonly", "vb")


@register("count_with_guard", fx.with_fixtures("""
SELECT 'orders' AS table_name, 'vb' AS served_by, count(*) AS n_rows FROM orders_b
UNION ALL SELECT 'lineitem', 'vb', count(*) FROM lineitem
""", orders_b=fx.ORDERS_B_SQL))
def q_count_with_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vb-readonly`` has its service stopped; ``vb`` is shared: fall back."""
    reg = given_registry(spark, sf_dir)
    reg.set_mode("B", "vb-readonly", "none")
    reg.set_mode("B", "vb", "shared")
    return count_with_guard(spark, reg, "B", ["orders", "lineitem"], "vb-readonly", "vb")


# --------------------------------------------------- replica core
@register("initial_copy",
          "SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-31 00:00:00'")
def q_initial_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return initial_copy(fx.orders_a(spark, sf_dir), "o_orderdate", "1998-12-31 00:00:00",
                        scratch_path(spark, "initial-copy"))


CHANGE_SPEC = ChangeSpec(keys=tuple(fx.CHANGE_KEYS), order=tuple(fx.CHANGE_ORDER), op_col="op")
VIEW_AS_OF = fx.PART_BOUNDARIES[2]


@register("readonly_view", fx.with_fixtures(f"""
SELECT user_id, ts, event_id, op, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT * FROM b0 UNION ALL
        SELECT * FROM cl WHERE ts <= TIMESTAMP '{VIEW_AS_OF}'))
WHERE rn = 1 AND op <> 'delete'
""", cl=fx.CHANGE_LOG_SQL, b0=fx.BASE_0_SQL))
def q_readonly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readonly_view(fx.base_0(spark, sf_dir), fx.change_log(spark, sf_dir), CHANGE_SPEC,
                         VIEW_AS_OF)


# ------------------------------------------------------ streaming
@register("replicate_stream", APPLY_CHANGES_SQL)
def q_replicate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log arrives in four parts; a running stream applies each
    arrival as micro-batches (each batch folded per key before it is stored).
    The drained batches folded equal the fold of the whole log."""
    stage, out = scratch_path(spark, "stage"), scratch_path(spark, "applied")
    ckpt = scratch_path(spark, "ckpt")
    schema = fx.change_log(spark, sf_dir).schema
    query = None
    try:
        for part in fx.change_parts(spark, sf_dir):
            fx.stage(part, stage)
            if query is None:  # a running stream that picks up each arrival
                query = replicate_stream(spark, stage, schema, out, ckpt,
                                         trigger={"processingTime": "100 milliseconds"},
                                         fold_spec=CHANGE_SPEC)
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    applied = read_batches(spark, out, schema)
    return apply_changes(applied, fx.CHANGE_KEYS, fx.CHANGE_ORDER)


@register("watch_counts", f"""
WITH e AS (SELECT *, {fx.CHANGE_PART_SQL} AS part FROM events),
f AS (SELECT p.part AS tick, event_type, row_number() OVER (PARTITION BY p.part, user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM e JOIN (SELECT DISTINCT part FROM e) p ON e.part <= p.part),
n AS (SELECT tick, count(*) FILTER (rn = 1 AND event_type <> 'error') AS n_b FROM f GROUP BY tick),
t AS (SELECT n.tick, a.n_b AS n_a, n.n_b, CASE WHEN n.n_b = a.n_b THEN 'match' ELSE 'mismatch' END AS verdict
      FROM n, (SELECT max_by(n_b, tick) AS n_b FROM n) a)
SELECT CAST(tick AS BIGINT) AS tick, n_a, n_b, verdict FROM t
WHERE tick <= (SELECT min(tick) FROM t WHERE verdict = 'match')
""")
def q_watch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A holds the users as all changes leave them. Side B gets the changes in four
    parts, as inserts, updates and deletes of its table; one tick after each."""
    reg = Registry(spark, scratch_path(spark, "registry"))
    out, ckpt, ticks = scratch_path(spark, "ticks"), scratch_path(spark, "ckpt"), None
    fold = lambda log, **kept: apply_changes(log, fx.CHANGE_KEYS, fx.CHANGE_ORDER, **kept)
    reg.mount("A", "va", "users", fold(fx.change_log(spark, sf_dir)))
    for part in fx.change_parts(spark, sf_dir):
        newest = fold(part, keep_deletes=True)
        load(reg, "B", "users", newest.filter("op <> 'delete'").drop("op"), fx.CHANGE_KEYS)
        remove(reg, "B", "users", newest.filter("op = 'delete'").select(*fx.CHANGE_KEYS), fx.CHANGE_KEYS)
        ticks = watch_counts(reg, "users", out, ckpt, available_now=True)
    return ticks


# ------------------------------------------------------ status
@register("replication_status", fx.with_fixtures(f"""
SELECT 'vb' AS replica, 'A->B' AS direction, w.status, CASE WHEN a.src > a.frontier_ts THEN 'add' ELSE 'ready' END AS data_state,
       a.frontier_ts, a.applied_rows, (epoch_us(a.src) - epoch_us(a.frontier_ts)) / 1000000.0 AS lag_s
FROM (SELECT max(ts) AS src, max(ts) FILTER (WHERE ts < TIMESTAMP '{VIEW_AS_OF}') AS frontier_ts,
             count(*) FILTER (WHERE ts < TIMESTAMP '{VIEW_AS_OF}') AS applied_rows FROM cl) a,
     (VALUES ('replicating'), ('stopped')) AS w(status)
""", cl=fx.CHANGE_LOG_SQL))
def q_replication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream applies three of the four parts of the source's changes. What another driver's
    registry object reads of it while it runs, and after it ended."""
    reg, key = Registry(spark, scratch_path(spark, "registry")), stream_key("CB", "vb", "users")
    log, parts = fx.change_log(spark, sf_dir), fx.change_parts(spark, sf_dir)
    stage, out = scratch_path(spark, "stage"), scratch_path(spark, "applied")
    fx.stage(parts[0], stage)
    beat = Heartbeat(reg, key, name=f"status-{key}-{out[-12:]}")
    query = replicate_stream(spark, stage, log.schema, out, scratch_path(spark, "ckpt"),
                             trigger={"processingTime": "100 milliseconds"}, query_name=beat.name)
    words = []
    try:
        for part in parts[1:3]:
            fx.stage(part, stage)
        query.processAllAvailable()
        for _ in range(100):  # events reach the listener a little later
            words = [recorded_word(Registry(spark, reg.root), key)]
            if words[0] == "replicating":
                break
            time.sleep(0.1)
    finally:
        query.stop()
        beat.close(query, "stopped")
    words.append(recorded_word(Registry(spark, reg.root), key))
    applied = read_batches(spark, out, log.schema)
    frames = [replication_status(applied, log, "ts", "vb", "A->B", stream_state=word, by_lag=True) for word in words]
    return frames[0].unionByName(frames[1])


READY_GATE_MAX_TRIES = 20


@register("ready_gate", fx.with_fixtures(f"""
SELECT replica, CASE WHEN f IS NOT NULL THEN 'ready' ELSE 'timeout' END AS verdict,
       CAST(coalesce(f, s) AS BIGINT) AS tries
FROM (
  SELECT replica,
         min(CASE WHEN try_no <= {READY_GATE_MAX_TRIES}
                   AND regexp_extract(lower(status_text),
                         '(initializing|replicating|offline|stopped|paused|error)', 1) = 'replicating'
                   AND regexp_extract(lower(data_state_text),
                         '(initializing|replicating|offline|error|ready|add)', 1) = 'ready'
                  THEN try_no END) AS f,
         max(CASE WHEN try_no <= {READY_GATE_MAX_TRIES} THEN try_no END) AS s
  FROM polls GROUP BY replica)
""", polls=fx.POLLS_SQL))
def q_ready_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls in ``(ts, event_id)`` order per replica; try numbers by position."""
    return ready_gate(fx.polls(spark, sf_dir), max_tries=READY_GATE_MAX_TRIES,
                      order=fx.POLL_ORDER)


# ------------------------------------------------ flows
@register("restart_replication", "SELECT * FROM orders")
def q_restart_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B holds the stale ``orders_b``; restart A->B makes B's read-only view
    equal to A's orders through diff + apply + stream."""
    reg = given_registry(spark, sf_dir)
    restart_replication(reg, "A", "B", "orders", ORDER_KEYS)
    return read_side(spark, reg, "B", None, "orders")


@register("restart_dry_run", f"SELECT action, count(*) AS n_rows FROM ({RESYNC_DIFF_SQL}) GROUP BY action")
def q_restart_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What restarting A->B over the stale ``orders_b`` would write, by action."""
    return restart_replication(given_registry(spark, sf_dir), "A", "B", "orders", ORDER_KEYS, dry_run=True)


CUTOVER_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 200 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority
FROM orders
"""


@register("cutover", CUTOVER_SQL)
def q_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate A->B, keep loading A (new orders, then status updates) while
    the stream runs, compact the replica once, then cut over: B's ``vb``
    equals A."""
    reg = Registry(spark, scratch_path(spark, "registry"))
    create_sides(reg)
    orders = fx.orders_a(spark, sf_dir)
    early = orders.filter(F.col("o_orderdate") < fx.ts_ntz("1999-01-01 00:00:00"))
    late = orders.filter(F.col("o_orderdate") >= fx.ts_ntz("1999-01-01 00:00:00"))
    load(reg, "A", "orders", early, ORDER_KEYS)
    rep = Replication(reg, "A", "B", "orders", ORDER_KEYS)
    rep.start()
    load(reg, "A", "orders", late, ORDER_KEYS)
    rep.run_stream(rep.info())
    rep.compact()  # fold the applied batches into the next base mid-stream
    updates = orders.filter(F.col("o_orderkey") % 200 == 0).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"))
    load(reg, "A", "orders", updates, ORDER_KEYS)
    rep.cutover()
    return read_side(spark, reg, "B", None, "orders")


def _health_sql(direction: str) -> str:
    return fx.with_fixtures(f"""
SELECT table_name, '{direction}' AS direction, 'va' AS served_by_a, n_a, 'vb' AS served_by_b, n_b,
       CASE WHEN n_a IS NULL OR n_b IS NULL THEN 'waiting'
            WHEN n_a = n_b THEN 'match' ELSE 'mismatch' END AS verdict
FROM (
  SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n_a,
         (SELECT count(*) FROM orders_b) AS n_b
  UNION ALL
  SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem))
""", orders_b=fx.ORDERS_B_SQL)


@register("health_report", _health_sql("A->B"))
def q_health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A->B recorded: A counted at ``va``; B at ``vb-readonly`` (absent) then ``vb``."""
    reg = given_registry(spark, sf_dir)
    reg.set_state(REPL_ATOB_ACTIVE, "1")
    return health_report(spark, reg, ["orders", "lineitem"])


@register("health_report_btoa", _health_sql("B->A"))
def q_health_report_btoa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B->A recorded: A counted at ``va-readonly`` (absent) then ``va``; B at ``vb``."""
    reg = given_registry(spark, sf_dir)
    reg.set_state(REPL_BTOA_ACTIVE, "1")
    return health_report(spark, reg, ["orders", "lineitem"])


@register("health_report_none", _health_sql("none"))
def q_health_report_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No direction recorded: each side's main namespace, then its read-only one."""
    return health_report(spark, given_registry(spark, sf_dir), ["orders", "lineitem"])


@register("health_report_full", fx.with_fixtures(f"""
SELECT * FROM (VALUES ('pointer', 'CA', 'default', 'va'), ('pointer', 'CB', 'default', 'vb'),
  ('namespace', 'CA', 'va', 'data_state=None service_mode=None'),
  ('namespace', 'CB', 'vb', 'data_state=None service_mode=None'),
  ('table', 'CB', 'orders', 'vb'), ('table', 'CB', 'lineitem', 'vb'),
  ('ingesting', 'CA', 'va', 'False'), ('ingesting', 'CB', 'vb', 'False'),
  ('flag', 'CA', '{REPL_BTOA_ACTIVE}', 'False'), ('flag', 'CB', '{REPL_ATOB_ACTIVE}', 'False'),
  {", ".join(f"('table', 'CA', '{t}', 'va')" for t in fx.TABLES)}) AS t(section, side, name, value)
UNION ALL SELECT 'count', 'CA', table_name, n_a || ' va' FROM h
UNION ALL SELECT 'count', 'CB', table_name, n_b || ' vb' FROM h
UNION ALL SELECT 'verdict', direction, table_name, verdict FROM h
""", h=_health_sql("none")))
def q_health_report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status report in one frame, no direction recorded."""
    return health_report(spark, given_registry(spark, sf_dir), ["orders", "lineitem"], detail="full")


SCENARIO_SLICES = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")


def scenario_loads(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three load slices of ``orders`` by order date (together: all orders)."""
    o = fx.orders_a(spark, sf_dir)
    d, (b1, b2) = F.col("o_orderdate"), SCENARIO_SLICES
    return [o.filter(d < fx.ts_ntz(b1)),
            o.filter((d >= fx.ts_ntz(b1)) & (d < fx.ts_ntz(b2))),
            o.filter(d >= fx.ts_ntz(b2))]


RUN_SCENARIO_SQL = f"""
WITH c AS (
  SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SCENARIO_SLICES[0]}') AS s1,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SCENARIO_SLICES[1]}') AS s12,
         count(*) AS s123
  FROM orders)
SELECT step_no, step, true AS ok, n_a, n_b, detail FROM (
  SELECT 1 AS step_no, 'load A' AS step, s1 AS n_a, NULL AS n_b, 'ok' AS detail FROM c
  UNION ALL SELECT 2, 'start A->B', s1, s1, 'ok' FROM c
  UNION ALL SELECT 3, 'cutover to B', s1, s1, 'ok' FROM c
  UNION ALL SELECT 4, 'load B', s1, s12, 'ok' FROM c
  UNION ALL SELECT 5, 'start B->A', s12, s12, 'ok' FROM c
  UNION ALL SELECT 6, 'cutover to A', s12, s12, 'ok' FROM c
  UNION ALL SELECT 7, 'load A again', s123, s12, 'ok' FROM c
  UNION ALL SELECT 8, 'status', s123, s12,
    CASE WHEN s123 = s12 THEN 'match' ELSE 'mismatch' END || ' (none)' FROM c
  UNION ALL SELECT 9, 'restart A->B', s123, s123, 'ok' FROM c
  UNION ALL SELECT 10, 'status', s123, s123, 'match (A->B)' FROM c)
"""


@register("run_scenario", RUN_SCENARIO_SQL)
def q_run_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = Registry(spark, scratch_path(spark, "scenario"))
    return run_scenario(spark, reg, "orders", ORDER_KEYS, scenario_loads(spark, sf_dir))
