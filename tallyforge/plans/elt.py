"""Landing, staging, marts, dashboards and usage roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyforge.sources.ingest import latest_by_key


def land_json_lines(spark: SparkSession, source: str, target: str, schema: T.StructType) -> DataFrame:
    """B1: JSON lines to a raw table, replaced as a whole; blank lines are no records."""
    spark.read.schema(schema).json(source).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def stage_parquet(spark: SparkSession, extract: DataFrame, path: str) -> DataFrame:
    """B2."""
    extract.write.mode("overwrite").parquet(path)
    return spark.read.schema(extract.schema).parquet(path)


def latest_versions(rows: DataFrame, key: str = "order_id", version: str = "updated_at") -> DataFrame:
    """B3."""
    return latest_by_key(rows, key, version)


def daily_revenue(orders: DataFrame) -> DataFrame:
    """B4."""
    total = F.sum("total_amount").cast("double")
    return orders.groupBy("order_date").agg(
        F.count("*").alias("order_count"), total.alias("revenue"),
        (total / F.count("total_amount")).alias("avg_order_value"))


def staged_orders(raw: DataFrame) -> DataFrame:
    """Typed, newest version per order, then only PAID, so a newer unpaid version hides the paid one."""
    typed = raw.select(
        F.col("order_id").cast("string").alias("order_id"), F.col("customer_id").cast("string").alias("customer_id"),
        F.col("order_date").cast("date").alias("order_date"),
        F.upper("status").alias("status"), F.col("total_amount").cast("decimal(18,2)").alias("total_amount"),
        F.col("updated_at").cast("timestamp").alias("updated_at"))
    return latest_versions(typed).filter("status = 'PAID'")


def staged_customers(raw: DataFrame) -> DataFrame:
    """B6."""
    return raw.select(
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("customer_name").cast("string").alias("customer_name"),
        F.col("segment").cast("string").alias("segment"))


def customer_revenue(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders are summed per customer before the join."""
    sums = orders.groupBy("customer_id").agg(
        F.count("*").alias("order_count"), F.sum("total_amount").cast("double").alias("revenue"),
        F.max("order_date").alias("latest_order_date"))
    return sums.join(customers, "customer_id").select(
        "customer_id", "customer_name", "segment", "order_count", "revenue", "latest_order_date")


def dashboard_kpis(orders: DataFrame) -> DataFrame:
    """B10."""
    return orders.agg(
        F.sum("revenue").cast("double").alias("total_revenue"), F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("customers"))


def monthly_trend(orders: DataFrame) -> DataFrame:
    """B11."""
    return orders.groupBy(F.date_format(F.date_trunc("month", "order_date"), "yyyy-MM").alias("month")).agg(
        F.sum("revenue").cast("double").alias("revenue"))


def category_breakdown(orders: DataFrame) -> DataFrame:
    """B12."""
    return orders.groupBy("category").agg(F.sum("revenue").cast("double").alias("revenue")).orderBy(
        F.desc("revenue"), "category")


def latest_detail(orders: DataFrame, n: int = 5) -> DataFrame:
    """B13."""
    return orders.orderBy(F.desc("order_date"), F.desc("order_id")).limit(n)


def team_kpis(accounts: DataFrame) -> DataFrame:
    """B16."""
    return accounts.filter("status is not null").groupBy("team").agg(
        F.count("*").alias("total_accounts"), F.sum("arr").cast("double").alias("total_arr"))


def tenant_revenue(events: DataFrame) -> DataFrame:
    """One table with a tenant column instead of one database per tenant."""
    return events.groupBy("tenant", "event_type").agg(
        F.count("*").alias("events"), F.sum("amount").cast("double").alias("revenue"))


# The counters of a usage record and where they are found.
USAGE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("usage", T.StructType([
            T.StructField("input_tokens", T.LongType()),
            T.StructField("output_tokens", T.LongType()),
            T.StructField("cache_creation_input_tokens", T.LongType()),
            T.StructField("cache_read_input_tokens", T.LongType()),
            T.StructField("cache_creation", T.StructType([
                T.StructField("ephemeral_5m_input_tokens", T.LongType()),
                T.StructField("ephemeral_1h_input_tokens", T.LongType()),
            ])),
        ])),
    ])),
])
COUNTERS = ["input", "output", "cache_create", "cache_read", "cc5m", "cc1h", "cc_unknown"]


def usage_rollup(
    lines: DataFrame, start: str, end: str, offset_minutes: int = 0, by_date: bool = True
) -> DataFrame:
    """(seq, line) JSON records -> counters per model, or per date and model.

    The first record of a message id counts; records without an id all count.
    Dates are those of a fixed offset from UTC.
    """
    e = lines.select("seq", F.from_json("line", USAGE).alias("e")).select("seq", "e.timestamp", "e.message.*")
    at = F.try_to_timestamp("timestamp") + F.make_dt_interval(mins=F.lit(offset_minutes))
    cc = F.col("usage.cache_creation")
    zero = lambda c: F.coalesce(c, F.lit(0))
    split = cc["ephemeral_5m_input_tokens"].isNotNull() | cc["ephemeral_1h_input_tokens"].isNotNull()
    split = F.coalesce(split, F.lit(False))
    created = zero(F.col("usage.cache_creation_input_tokens"))
    rows = e.filter("usage is not null and timestamp is not null").select(
        "seq", "id", F.coalesce("model", F.lit("unknown")).alias("model"), F.to_date(at).alias("date"),
        zero(F.col("usage.input_tokens")).alias("input"), zero(F.col("usage.output_tokens")).alias("output"),
        created.alias("cache_create"), zero(F.col("usage.cache_read_input_tokens")).alias("cache_read"),
        F.when(split, zero(cc["ephemeral_5m_input_tokens"])).otherwise(0).alias("cc5m"),
        F.when(split, zero(cc["ephemeral_1h_input_tokens"])).otherwise(0).alias("cc1h"),
        F.when(split, F.lit(0)).otherwise(created).alias("cc_unknown"),
    ).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    has_id = F.coalesce(F.col("id") != "", F.lit(False))
    first = latest_by_key(rows.filter(has_id).withColumn("_turn", -F.col("seq")), "id", "_turn").drop("_turn")
    counted = first.unionByName(rows.filter(~has_id))
    keys = ["date", "model"] if by_date else ["model"]
    return counted.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("messages"))


def longest_prefix_rates(models: DataFrame, rates: DataFrame) -> DataFrame:
    """Each distinct model name with the rate whose key is its longest prefix.

    All prefixes of the distinct names are joined by equality.
    """
    names = models.select("model").distinct()
    prefixes = names.select("model", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("model")), lambda i: F.substring(F.col("model"), F.lit(1), i))).alias("key"))
    rest = [c for c in rates.columns if c != "key"]
    hits = prefixes.join(rates, "key")
    return hits.groupBy("model").agg(
        F.max(F.struct(F.length("key").alias("n"), "key", *rest)).alias("r")
    ).select("model", "r.key", *[f"r.{c}" for c in rest])


# Price of cache writes and reads as multiples of the input rate.
CACHE_WRITE_5M, CACHE_WRITE_1H, CACHE_READ = 1.25, 2.0, 0.1


def usage_cost(per_model: DataFrame, rates: DataFrame, unknown_ttl: float = CACHE_WRITE_5M) -> DataFrame:
    """Cost per model from (key, input_rate, output_rate) per million; unpriced models stay NULL."""
    priced = per_model.join(longest_prefix_rates(per_model, rates), "model", "left")
    million = lambda c: F.col(c) / 1e6
    rate = F.col("input_rate")
    write = rate * (
        million("cc5m") * CACHE_WRITE_5M + million("cc1h") * CACHE_WRITE_1H + million("cc_unknown") * unknown_ttl)
    return priced.withColumns({
        "input_cost": million("input") * rate, "output_cost": million("output") * F.col("output_rate"),
        "cache_write_cost": write, "cache_read_cost": million("cache_read") * rate * CACHE_READ,
    }).withColumn(
        "total_cost",
        F.col("input_cost") + F.col("output_cost") + F.col("cache_write_cost") + F.col("cache_read_cost"),
    ).select("model", "key", "input_cost", "output_cost", "cache_write_cost", "cache_read_cost", "total_cost")


def benchmark_stats(runs: DataFrame, metric: str, group: str = "configuration") -> DataFrame:
    """Mean, sample deviation (0 for one run), minimum and maximum per configuration."""
    c = F.col(metric)
    return runs.groupBy(group).agg(
        F.bround(F.avg(c), 4).alias("mean"),
        F.bround(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("stddev"),
        F.bround(F.min(c), 4).alias("min"), F.bround(F.max(c), 4).alias("max"))


def benchmark_delta(stats: DataFrame, first: str, second: str, group: str = "configuration") -> DataFrame:
    a = stats.filter(F.col(group) == first).select(F.col("mean").alias("a"))
    b = stats.filter(F.col(group) == second).select(F.col("mean").alias("b"))
    return a.join(b, F.lit(True)).select(F.round(F.col("a") - F.col("b"), 4).alias("delta"))
