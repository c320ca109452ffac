"""Registered queries: executable data artifacts (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.operators import quality
from tallyforge.plans import elt
from tallyforge.registry.core import Registry
from tallyforge.session import new_path
from tallyforge.sources import tables as t

LANDING = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("order_date", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("total_amount", T.StringType()), T.StructField("updated_at", T.StringType()),
])
# Every order in one or two versions; a later version may be unpaid.
LANDING_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(o_orderdate AS DATE) AS order_date,
           CASE WHEN v = 2 AND o_orderkey % 5 = 0 THEN 'REFUNDED' WHEN o_orderkey % 11 = 0 THEN 'OPEN' ELSE 'PAID' END AS status,
           CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN v = 2 THEN 10 ELSE 0 END AS total_amount, v
    FROM orders, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR o_orderkey % 3 = 0"""
STAGED_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY v DESC) AS rn FROM ({LANDING_SQL}))
    WHERE rn = 1"""


def _landing(s, d) -> DataFrame:
    o = t.table(s, d, "orders")
    v, k = F.col("v"), F.col("o_orderkey")
    versions = F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return o.withColumn("v", F.explode(versions)).select(
        k.cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"),
        F.to_date("o_orderdate").cast("string").alias("order_date"),
        F.when((v == 2) & (k % 5 == 0), "refunded").when(k % 11 == 0, "open").otherwise("paid").alias("status"),
        (F.col("o_totalprice").cast("decimal(18,2)") + F.when(v == 2, 10).otherwise(0)).cast("string").alias("total_amount"),
        F.concat(F.lit("2026-01-0"), v.cast("string"), F.lit(" 00:00:00")).alias("updated_at"))


def _raw(s, d) -> DataFrame:
    source, target = new_path(s, "jsonl"), new_path(s, "raw")
    _landing(s, d).write.json(source)
    return elt.land_json_lines(s, source, target, LANDING)


def _customers(s, d) -> DataFrame:
    return elt.staged_customers(t.table(s, d, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment")))


def _dashboard(s, d) -> DataFrame:
    o, c = t.table(s, d, "orders"), t.table(s, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"),
        F.col("c_mktsegment").alias("category"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"))


DASH_SQL = """(SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, c_mktsegment AS category,
    o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _target(s, d) -> tuple[DataFrame, DataFrame]:
    """A migrated copy with lost, added and changed orders."""
    src = t.table(s, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"))
    k = F.col("order_id")
    new = src.filter(k % 101 == 0).withColumn("order_id", -k - 1)
    tgt = src.filter(k % 97 != 0).withColumn(
        "total_amount", F.when(k % 50 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount")).cast("decimal(18,2)")
    ).unionByName(new)
    return src, tgt


SOURCE_SQL = "(SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount FROM orders)"
TARGET_SQL = f"""(SELECT order_id, total_amount + CASE WHEN order_id % 50 = 0 THEN 1 ELSE 0 END AS total_amount
    FROM {SOURCE_SQL} WHERE order_id % 97 <> 0
    UNION ALL SELECT -order_id - 1, total_amount FROM {SOURCE_SQL} WHERE order_id % 101 = 0)"""


def _usage_lines(s, d) -> DataFrame:
    e, k = t.table(s, d, "events"), F.col("event_id")
    n = F.floor(F.col("value") * 10).cast("long")
    cache = F.when(k % 3 == 0, F.struct(
        n.alias("ephemeral_5m_input_tokens"), (n * 2).alias("ephemeral_1h_input_tokens")))
    message = F.struct(
        F.when(k % 10 != 0, F.concat(F.lit("m"), F.floor(k / 2).cast("string"))).alias("id"),
        F.when(k % 17 != 0, F.concat(F.lit("meter-"), "event_type", F.lit("-v"), (k % 4).cast("string"))).alias("model"),
        F.struct(
            n.alias("input_tokens"), (n * 3).alias("output_tokens"), (n * 3).alias("cache_creation_input_tokens"),
            F.when(k % 4 == 0, n).alias("cache_read_input_tokens"), cache.alias("cache_creation")).alias("usage"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = F.when(k % 29 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(stamp.alias("timestamp"), message.alias("message"))))
    return e.select(k.alias("seq"), line.alias("line"))


USAGE_ROWS_SQL = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(id, 's' || seq) ORDER BY seq) AS rn FROM (
        SELECT event_id AS seq, CASE WHEN event_id % 10 <> 0 THEN 'm' || (event_id // 2) END AS id,
               CASE WHEN event_id % 17 <> 0 THEN 'meter-' || event_type || '-v' || (event_id % 4) ELSE 'unknown' END AS model,
               CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, CAST(floor(value * 10) AS BIGINT) AS n
        FROM events WHERE event_id % 29 <> 0)
    WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25') WHERE rn = 1"""
USAGE_SUMS = """CAST(sum(n) AS BIGINT) AS input, CAST(sum(n * 3) AS BIGINT) AS output,
    CAST(sum(n * 3) AS BIGINT) AS cache_create, CAST(sum(CASE WHEN seq % 4 = 0 THEN n ELSE 0 END) AS BIGINT) AS cache_read,
    CAST(sum(CASE WHEN seq % 3 = 0 THEN n ELSE 0 END) AS BIGINT) AS cc5m,
    CAST(sum(CASE WHEN seq % 3 = 0 THEN n * 2 ELSE 0 END) AS BIGINT) AS cc1h,
    CAST(sum(CASE WHEN seq % 3 <> 0 THEN n * 3 ELSE 0 END) AS BIGINT) AS cc_unknown, count(*) AS messages"""


def _rates(s, d) -> DataFrame:
    """A rate per event type, and a longer key for its newest version."""
    kinds = t.table(s, d, "events").groupBy("event_type").agg(F.length(F.max("event_type")).alias("n"))
    base = kinds.select(F.concat(F.lit("meter-"), "event_type").alias("key"), F.col("n").cast("double").alias("input_rate"),
                        (F.col("n") * 5.0).alias("output_rate"))
    newer = kinds.select(F.concat(F.lit("meter-"), "event_type", F.lit("-v3")).alias("key"),
                         (F.col("n") * 2.0).alias("input_rate"), (F.col("n") * 8.0).alias("output_rate"))
    return base.unionByName(newer)


def register(reg: Registry):
    reg.add("B1_json_lines_landing", lambda s, d: _raw(s, d).groupBy("status").agg(F.count("*").alias("n")),
            f"SELECT lower(status) AS status, count(*) AS n FROM ({LANDING_SQL}) GROUP BY 1")
    reg.add(
        "B2_parquet_stage",
        lambda s, d: elt.stage_parquet(s, _landing(s, d), new_path(s, "stage")).select("order_id", "status", "total_amount"),
        f"SELECT order_id, lower(status) AS status, CAST(total_amount AS VARCHAR) AS total_amount FROM ({LANDING_SQL})")
    reg.add(
        "B3_latest_version",
        lambda s, d: elt.latest_versions(_landing(s, d)).select("order_id", F.upper("status").alias("status")),
        f"SELECT order_id, status FROM ({STAGED_SQL})")
    reg.add("B4_daily_revenue", lambda s, d: elt.daily_revenue(elt.staged_orders(_landing(s, d))), f"""
        SELECT CAST(order_date AS VARCHAR) AS order_date, count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS revenue,
               CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value
        FROM ({STAGED_SQL}) s WHERE status = 'PAID' GROUP BY s.order_date""")
    reg.add("B5_typed_staging", lambda s, d: elt.staged_orders(_raw(s, d)).drop("updated_at"), f"""
        SELECT order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, status,
               CAST(total_amount AS DOUBLE) AS total_amount FROM ({STAGED_SQL}) WHERE status = 'PAID'""")
    reg.add("B6_customer_staging", _customers, """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer""")
    reg.add("B7_customer_revenue_fact",
            lambda s, d: elt.customer_revenue(elt.staged_orders(_landing(s, d)), _customers(s, d)), f"""
        SELECT customer_id, c_name AS customer_name, c_mktsegment AS segment, count(*) AS order_count,
               CAST(sum(total_amount) AS DOUBLE) AS revenue, CAST(max(order_date) AS VARCHAR) AS latest_order_date
        FROM ({STAGED_SQL}) JOIN customer ON CAST(c_custkey AS VARCHAR) = customer_id
        WHERE status = 'PAID' GROUP BY ALL""")

    def tests(s, d):
        raw, staged, cust = _landing(s, d), elt.staged_orders(_landing(s, d)), _customers(s, d)
        return quality.run_checks({
            "raw_order_id_unique": quality.not_unique(raw, "order_id"),
            "order_id_unique": quality.not_unique(staged, "order_id"),
            "customer_id_not_null": quality.nulls(staged, "customer_id"),
            "customer_exists": quality.without_parent(staged, "customer_id", cust, "customer_id"),
            "segment_known": quality.without_parent(cust, "segment", cust.filter("segment <> 'BUILDING'"), "segment")})

    reg.add("B8_data_tests", tests, """
        SELECT 'raw_order_id_unique' AS check_name, count(*) AS violations FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT unnest(['order_id_unique', 'customer_id_not_null', 'customer_exists']), 0
        UNION ALL SELECT 'segment_known', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""")

    def stages(s, d):
        landing = _landing(s, d)
        staged = elt.staged_orders(landing)
        cust = _customers(s, d)
        return quality.row_counts({
            "raw_orders": landing, "raw_customers": cust, "stg_orders": staged,
            "fct_customer_revenue": elt.customer_revenue(staged, cust)})

    reg.add("B9_stage_row_counts", stages, f"""
        SELECT 'raw_orders' AS stage, count(*) AS n FROM ({LANDING_SQL})
        UNION ALL SELECT 'raw_customers', count(*) FROM customer
        UNION ALL SELECT 'stg_orders', count(*) FROM ({STAGED_SQL}) WHERE status = 'PAID'
        UNION ALL SELECT 'fct_customer_revenue', count(DISTINCT customer_id) FROM ({STAGED_SQL}) WHERE status = 'PAID'""")
    reg.add("B10_dashboard_kpis", lambda s, d: elt.dashboard_kpis(_dashboard(s, d)), f"""
        SELECT CAST(sum(revenue) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS orders,
               count(DISTINCT customer_id) AS customers FROM {DASH_SQL}""")
    reg.add("B11_monthly_trend", lambda s, d: elt.monthly_trend(_dashboard(s, d)), f"""
        SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {DASH_SQL} GROUP BY 1""")
    reg.add("B12_category_breakdown", lambda s, d: elt.category_breakdown(_dashboard(s, d)),
            f"SELECT category, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {DASH_SQL} GROUP BY 1")
    reg.add("B13_latest_detail", lambda s, d: elt.latest_detail(_dashboard(s, d)), f"""
        SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, category, customer_id, CAST(revenue AS DOUBLE) AS revenue
        FROM {DASH_SQL} q ORDER BY q.order_date DESC, order_id DESC LIMIT 5""")
    reg.add("B14_metric_variance", lambda s, d: quality.metric_variance(*_target(s, d), "total_amount"), f"""
        SELECT metric, s AS source_value, g AS target_value, CASE WHEN s <> 0 THEN round_even(100.0 * (g - s) / s, 4) END
               AS pct_variance FROM (
            SELECT unnest(['count', 'sum', 'avg', 'min', 'max']) AS metric, unnest(a.m) AS s, unnest(b.m) AS g FROM
              (SELECT [CAST(count(*) AS DOUBLE), CAST(sum(total_amount) AS DOUBLE),
                       CAST(sum(total_amount) AS DOUBLE) / count(*), CAST(min(total_amount) AS DOUBLE),
                       CAST(max(total_amount) AS DOUBLE)] AS m FROM {SOURCE_SQL}) a,
              (SELECT [CAST(count(*) AS DOUBLE), CAST(sum(total_amount) AS DOUBLE),
                       CAST(sum(total_amount) AS DOUBLE) / count(*), CAST(min(total_amount) AS DOUBLE),
                       CAST(max(total_amount) AS DOUBLE)] AS m FROM {TARGET_SQL}) b)""")
    reg.add("B15_key_differences", lambda s, d: quality.key_differences(*_target(s, d), "order_id"), f"""
        SELECT order_id, 'new' AS change FROM (SELECT order_id FROM {TARGET_SQL} EXCEPT SELECT order_id FROM {SOURCE_SQL})
        UNION ALL SELECT order_id, 'deleted' FROM
            (SELECT order_id FROM {SOURCE_SQL} EXCEPT SELECT order_id FROM {TARGET_SQL})""")

    def accounts(s, d):
        return elt.team_kpis(t.table(s, d, "customer").select(
            F.col("c_mktsegment").alias("team"), F.when(F.col("c_custkey") % 7 != 0, "ok").alias("status"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("arr")))

    reg.add("B16_team_kpis", accounts, """
        SELECT c_mktsegment AS team, count(*) AS total_accounts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_arr
        FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1""")
    reg.add("B17_tenant_revenue", lambda s, d: elt.tenant_revenue(t.table(s, d, "events").select(
        F.col("user_id").alias("tenant"), "event_type", F.col("value").cast("decimal(18,2)").alias("amount"))), """
        SELECT user_id AS tenant, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM events GROUP BY ALL""")
    usage = lambda s, d, by: elt.usage_rollup(_usage_lines(s, d), "2024-01-03", "2024-01-25", 330, by)
    reg.add("B18_usage_by_date_and_model", lambda s, d: usage(s, d, True),
            f"SELECT CAST(u.date AS VARCHAR) AS date, model, {USAGE_SUMS} FROM ({USAGE_ROWS_SQL}) u GROUP BY u.date, model")
    reg.add("B18_usage_by_model", lambda s, d: usage(s, d, False),
            f"SELECT model, {USAGE_SUMS} FROM ({USAGE_ROWS_SQL}) GROUP BY 1")
    reg.add("B19_longest_prefix_cost", lambda s, d: elt.usage_cost(usage(s, d, False), _rates(s, d)).select(
        "model", "key", *[F.round(c, 8).alias(c) for c in (
            "input_cost", "output_cost", "cache_write_cost", "cache_read_cost", "total_cost")]), f"""
        SELECT model, key, round(i, 8) AS input_cost, round(o, 8) AS output_cost, round(w, 8) AS cache_write_cost,
               round(r, 8) AS cache_read_cost, round(i + o + w + r, 8) AS total_cost FROM (
            SELECT model, key, input / 1e6 * ir AS i, output / 1e6 * orr AS o,
                   ir * (cc5m / 1e6 * 1.25 + cc1h / 1e6 * 2.0 + cc_unknown / 1e6 * 1.25) AS w,
                   cache_read / 1e6 * ir * 0.1 AS r
            FROM (SELECT u.*, k.key, k.ir, k.orr, row_number() OVER (PARTITION BY model ORDER BY length(key) DESC) AS rn
                  FROM (SELECT model, {USAGE_SUMS} FROM ({USAGE_ROWS_SQL}) GROUP BY 1) u LEFT JOIN (
                      SELECT 'meter-' || event_type AS key, CAST(length(event_type) AS DOUBLE) AS ir,
                             length(event_type) * CAST(5 AS DOUBLE) AS orr FROM (SELECT DISTINCT event_type FROM events)
                      UNION ALL SELECT 'meter-' || event_type || '-v3', length(event_type) * CAST(2 AS DOUBLE),
                             length(event_type) * CAST(8 AS DOUBLE) FROM (SELECT DISTINCT event_type FROM events)) k
                  ON starts_with(u.model, k.key)) WHERE rn = 1)""")

    def bench(s, d):
        runs = t.table(s, d, "lineitem").select(
            F.col("l_returnflag").alias("configuration"), F.col("l_quantity").alias("quantity"))
        return elt.benchmark_stats(runs, "quantity")

    stats_sql = """SELECT l_returnflag AS configuration, round_even(avg(l_quantity), 4) AS mean,
        round_even(coalesce(stddev_samp(l_quantity), 0), 4) AS stddev, round_even(min(l_quantity), 4) AS min,
        round_even(max(l_quantity), 4) AS max FROM lineitem GROUP BY 1"""
    reg.add("B20_benchmark_stats", bench, stats_sql)
    reg.add("B20_benchmark_delta", lambda s, d: elt.benchmark_delta(bench(s, d), "A", "N"), f"""
        SELECT round(a.mean - b.mean, 4) AS delta FROM ({stats_sql}) a, ({stats_sql}) b
        WHERE a.configuration = 'A' AND b.configuration = 'N'""")
