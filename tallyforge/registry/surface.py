"""Registered queries: the documented SQL surface (D), as plain DataFrame queries.

Windows run over pre-aggregated series (a calendar bounds their length) or
through the range-partitioned form where they must see raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyforge.operators import quality, skewjoin
from tallyforge.operators.splitwindow import OrderedParts, sessions
from tallyforge.registry.core import Registry
from tallyforge.session import cut, new_path
from tallyforge.sources import readers
from tallyforge.sources import tables as t


def T_(name):
    return lambda s, d: t.table(s, d, name)


orders, customer, lineitem, events, nation, region, part = (
    T_(n) for n in ("orders", "customer", "lineitem", "events", "nation", "region", "part"))


def cents(c: str):
    return F.floor(F.col(c) * 100 + F.lit(0.5)).cast("long")


def daily(s, d) -> DataFrame:
    """Orders per priority and day."""
    return orders(s, d).groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("rev"))


DAILY = """(SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS rev FROM orders GROUP BY ALL)"""


def monthly(s, d) -> DataFrame:
    return orders(s, d).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum(cents("o_totalprice")).alias("rev"))


MONTHLY = """(SELECT strftime(o_orderdate, '%Y-%m') AS month,
    CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS rev FROM orders GROUP BY 1)"""
DAY_W = "PARTITION BY o_orderpriority ORDER BY day"


def day_window():
    return Window.partitionBy("o_orderpriority").orderBy("day")


def on_daily(*cols):
    """A query that adds window columns to the daily series."""
    return lambda s, d: daily(s, d).select("o_orderpriority", "day", *[c().alias(n) for n, c in cols])


def daily_sql(*cols):
    inner = ", ".join(f"{sql} AS {n}" for n, sql in cols)
    return f"SELECT o_orderpriority, CAST(q.day AS VARCHAR) AS day, {', '.join(n for n, _ in cols)} FROM (" \
           f"SELECT o_orderpriority, day, {inner} FROM {DAILY}) q"


def register(reg: Registry):
    _scans(reg)
    _joins(reg)
    _aggregates(reg)
    _windows(reg)
    _shapes(reg)
    _checks(reg)


def _scans(reg: Registry):
    def scans(s, d):
        c = customer(s, d).select("c_custkey", "c_name", "c_nationkey")
        out = None
        for fmt in ("csv", "json", "parquet"):
            path = new_path(s, fmt)
            w = c.write.option("header", True) if fmt == "csv" else c.write
            w.format(fmt).save(path)
            df = readers.read_file(s, path, c.schema, fmt)
            one = df.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).withColumn(
                "fmt", F.lit(fmt))
            out = one if out is None else out.unionByName(one)
        return out

    reg.add("D1_D2_file_scans", scans, """
        SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, fmt
        FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt) GROUP BY ALL""")

    def exported(s, d):
        path = new_path(s, "export")
        orders(s, d).withColumn("yr", F.year("o_orderdate")).write.partitionBy("yr").parquet(path)
        as_csv = readers.convert(s, path, "parquet", new_path(s, "converted"), "csv")
        return as_csv.groupBy(F.col("yr").cast("int").alias("yr")).agg(
            F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))

    reg.add("D3_partitioned_export", exported, """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM orders GROUP BY 1""")

    def spine(s, d):
        return orders(s, d).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).select(
            F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start"))

    reg.add("D4_generate_series", spine, """
        SELECT CAST(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS VARCHAR) AS month_start FROM (
            SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders)""")
    reg.add("D5_unnest_list", lambda s, d: t.table(s, d, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("positive")), """
        SELECT pos - 1 AS pos, count(*) AS n, count(*) FILTER (x > 0) AS positive FROM (
            SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1""")
    reg.add("D5_unnest_struct", lambda s, d: orders(s, d).select(
        F.struct("o_orderkey", F.struct("o_orderstatus", "o_custkey").alias("who")).alias("r")).select("r.*").select(
        "o_orderkey", "who.*"), "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
    reg.add("D6_projection", lambda s, d: customer(s, d).drop("c_acctbal").withColumn(
        "c_name", F.upper("c_name")).withColumn("double_key", F.col("c_custkey") * 2).withColumn(
        "next_key", F.col("double_key") + 1).filter("next_key > 100"), """
        SELECT * FROM (SELECT * EXCLUDE (c_acctbal) REPLACE (upper(c_name) AS c_name), c_custkey * 2 AS double_key,
               c_custkey * 2 + 1 AS next_key FROM customer) WHERE next_key > 100""")
    reg.add("D7_range_filter", lambda s, d: lineitem(s, d).filter(
        (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)).agg(
        F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("price")), """
        SELECT count(*) AS n, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS price FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
          AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
    reg.add("D8_patterns", lambda s, d: part(s, d).select(
        "p_partkey", F.col("p_name").like("%ring").alias("is_like"), F.col("p_name").ilike("RED%").alias("is_ilike"),
        F.col("p_name").rlike("^(?:small|large) .*$").alias("is_similar")), """
        SELECT p_partkey, p_name LIKE '%ring' AS is_like, p_name ILIKE 'RED%' AS is_ilike,
               p_name SIMILAR TO '(small|large) .*' AS is_similar FROM part""")

    def csv_options(s, d):
        path = new_path(s, "ragged")
        n = nation(s, d)
        line = lambda *xs: F.concat_ws("|", *xs)
        lines = n.select(F.explode(F.array(
            line("n_nationkey", "n_name", F.lit("31.12.2024")),
            F.when(F.col("n_nationkey") % 5 == 0, line("n_nationkey", F.lit("short"))).otherwise(
                line("n_nationkey", F.lit("extra"), F.lit("01.02.2024"))),
            F.lit("# note"))).alias("value"))
        lines.write.text(path)
        schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()),
                               T.StructField("day", T.DateType())])
        strict = s.read.schema(schema).options(sep="|", comment="#", dateFormat="dd.MM.yyyy", mode="DROPMALFORMED").csv(path)
        lenient = s.read.schema(schema).options(sep="|", comment="#", dateFormat="dd.MM.yyyy", mode="PERMISSIVE").csv(path)
        text = s.read.schema("k string, name string, day string").options(sep="|", comment="#").csv(path)
        return (
            strict.agg(F.count("day").alias("n")).withColumn("how", F.lit("strict"))
            .unionByName(lenient.agg(F.count("*").alias("n")).withColumn("how", F.lit("lenient")))
            .unionByName(text.filter("name = 'short'").agg(F.count("*").alias("n")).withColumn("how", F.lit("short"))))

    reg.add("D56_csv_options", csv_options, """
        SELECT 'strict' AS how, count(*) * 2 - count(*) FILTER (n_nationkey % 5 = 0) AS n FROM nation
        UNION ALL SELECT 'lenient', count(*) * 2 FROM nation
        UNION ALL SELECT 'short', count(*) FILTER (n_nationkey % 5 = 0) FROM nation""")

    def evolved(s, d):
        path = new_path(s, "evolved")
        n = nation(s, d).select("n_nationkey", "n_name")
        n.write.parquet(f"{path}/load=1")
        n.withColumn("extra", F.lit("x")).write.parquet(f"{path}/load=2")
        df = s.read.option("mergeSchema", True).parquet(path)
        return df.select("load", F.col("_metadata.file_name").endswith(".parquet").alias("is_file"), "extra").groupBy(
            "load", "is_file").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))

    reg.add("D57_partitions_and_schema_evolution", evolved, """
        SELECT CAST(load AS INTEGER) AS load, true AS is_file, count(*) AS n, count(*) FILTER (load = 2) AS n_extra
        FROM nation, (SELECT unnest([1, 2]) AS load) GROUP BY load""")
    reg.add("D58_nested_json", lambda s, d: events(s, d).select(
        "event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k"), """
        SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events""")

    def tables(s, d):
        base = new_path(s, "ctas")
        orders(s, d).filter("o_orderstatus = 'F'").write.parquet(base)
        orders(s, d).filter("o_orderstatus <> 'F' OR o_orderstatus IS NULL").write.mode("append").parquet(base)
        s.read.parquet(base).createOrReplaceTempView("filled_then_others")
        return s.sql("""WITH totals AS (SELECT o_orderstatus, count(*) AS n FROM filled_then_others GROUP BY o_orderstatus)
                        SELECT o_orderstatus, n FROM totals""")

    reg.add("D46_cte_and_table_as_select", tables, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
    reg.add("D48_sampling", lambda s, d: lineitem(s, d).sample(fraction=0.1, seed=7).groupBy("l_returnflag").agg(
        (F.count("*") > 0).alias("some")), "SELECT DISTINCT l_returnflag, true AS some FROM lineitem")
    reg.add("D48_sample_rows", lambda s, d: lineitem(s, d).select("l_orderkey", "l_linenumber").limit(100))
    reg.add("D52_explain", lambda s, d: _plan_text(s, d))


def _plan_text(s, d):
    """The formatted plan of a filtered aggregate, one row per line."""
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        lineitem(s, d).filter("l_quantity < 10").groupBy("l_returnflag").count().explain("formatted")
    lines = [(i, x) for i, x in enumerate(out.getvalue().splitlines())]
    return s.createDataFrame(lines, "line int, text string")


def _joins(reg: Registry):
    def typed(how):
        def run(s, d):
            c = customer(s, d).select("c_custkey", "c_mktsegment")
            o = orders(s, d).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
            j = c.join(o, "c_custkey", how)
            has_order = "o_orderkey" in j.columns
            return j.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"),
                         (F.count("o_orderkey") if has_order else F.lit(0).cast("long")).alias("orders"))
        return run

    both = "customer {} JOIN orders ON c_custkey = o_custkey"
    for how, sql, key, n in (
        ("inner", "INNER", "c_custkey", "count(o_orderkey)"), ("left", "LEFT", "c_custkey", "count(o_orderkey)"),
        ("right", "RIGHT", "o_custkey", "count(o_orderkey)"),
        ("full", "FULL", "coalesce(c_custkey, o_custkey)", "count(o_orderkey)"),
        ("left_semi", "SEMI", "c_custkey", "0"), ("left_anti", "ANTI", "c_custkey", "0"),
    ):
        reg.add(f"D9_join_{how}", typed(how),
                f"SELECT count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys, {n} AS orders FROM {both.format(sql)}")

    def share(s, d):
        total = orders(s, d).agg(F.count("*").alias("total"))
        return orders(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(total, F.lit(True)).select(
            "o_orderstatus", F.round(F.col("n") / F.col("total"), 8).alias("share"))

    reg.add("D9_join_cross_with_one_row", share, """
        SELECT o_orderstatus, round(n / total, 8) AS share FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
        CROSS JOIN (SELECT count(*) AS total FROM orders)""")
    by_nation = """SELECT n_name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
    reg.add("D10_broadcast_join", lambda s, d: customer(s, d).join(
        skewjoin.broadcast_if_small(nation(s, d)), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("n"), F.sum("c_custkey").alias("keys")), by_nation)

    def salted(s, d):
        many = lineitem(s, d).select(
            F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("l_partkey")).alias("p_partkey"), "l_quantity",
            "l_orderkey", "l_linenumber")
        return skewjoin.salted_join(many, part(s, d).select("p_partkey", "p_brand"), "p_partkey", hot_rows=1000).groupBy(
            "p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))

    reg.add("D11_skewed_join_salted", salted, """
        SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
        FROM lineitem JOIN part ON p_partkey = CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END GROUP BY 1""")

    def gaps(s, d):
        keys = lineitem(s, d).select("l_orderkey").distinct().withColumn("g", F.lit(0))
        return OrderedParts(keys, ["g"], ["l_orderkey"]).lag("previous", F.col("l_orderkey")).result().filter(
            "l_orderkey - previous > 1").select(
            (F.col("previous") + 1).alias("gap_start"), (F.col("l_orderkey") - 1).alias("gap_end"))

    reg.add("D12_sequence_gaps", gaps, """
        SELECT previous + 1 AS gap_start, l_orderkey - 1 AS gap_end FROM (
            SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY l_orderkey) AS previous FROM (
                SELECT DISTINCT l_orderkey FROM lineitem)) WHERE l_orderkey - previous > 1""")

    def top3(s, d):
        w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
        return orders(s, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select(
            "o_custkey", "o_orderkey", "rn")

    reg.add("D13_lateral_top3", top3, """
        SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
               ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
    reg.add("D14_anti_join", lambda s, d: customer(s, d).join(
        orders(s, d).filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"
    ).select("c_custkey", "c_name"), """
        SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (
            SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F')""")

    def correlated(s, d):
        orders(s, d).createOrReplaceTempView("all_orders")
        return s.sql("""
            SELECT o.o_orderkey, o.o_custkey FROM all_orders o
            WHERE o.o_totalprice > (SELECT avg(i.o_totalprice) * 1.5 FROM all_orders i WHERE i.o_custkey = o.o_custkey)
              AND o.o_totalprice < (SELECT max(o_totalprice) FROM all_orders)""")

    reg.add("D15_correlated_subqueries", correlated, """
        SELECT o.o_orderkey, o.o_custkey FROM orders o
        WHERE o.o_totalprice > (SELECT avg(i.o_totalprice) * 1.5 FROM orders i WHERE i.o_custkey = o.o_custkey)
          AND o.o_totalprice < (SELECT max(o_totalprice) FROM orders)""")

    def merged(s, d):
        left = customer(s, d).select("c_custkey", "c_name")
        right = orders(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
        return skewjoin.checked_merge(left, right, ["c_custkey"], "1:1").groupBy("source_flag").agg(
            F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))

    reg.add("D16_checked_merge", merged, """
        SELECT CASE WHEN c IS NULL THEN 'right_only' WHEN o IS NULL THEN 'left_only' ELSE 'both' END AS source_flag,
               count(*) AS n, CAST(sum(coalesce(c, o)) AS BIGINT) AS keys
        FROM (SELECT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o
        GROUP BY 1""")


def _aggregates(reg: Registry):
    reg.add("D17_aggregates_with_filter", lambda s, d: lineitem(s, d).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(cents("l_extendedprice")).alias("price"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        F.countDistinct("l_orderkey").alias("orders"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.round(F.avg("l_quantity"), 8).alias("avg_qty")), """
        SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
               CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS price, min(l_quantity) AS lo,
               max(l_quantity) AS hi, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_discount > 0.05) AS discounted,
               round(avg(l_quantity), 8) AS avg_qty FROM lineitem GROUP BY ALL""")
    reg.add("D18_first_last_argmax", lambda s, d: orders(s, d).groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest")), """
        SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order,
               last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order,
               last(o_orderkey ORDER BY o_totalprice, o_orderkey) AS largest FROM orders GROUP BY 1""")
    # Lists hold distinct values of a small domain, never the rows of a group.
    reg.add("D19_list_and_string_agg", lambda s, d: orders(s, d).groupBy("o_orderstatus").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("priorities"),
        F.size(F.collect_set(F.year("o_orderdate"))).alias("years")), """
        SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities,
               len(list(DISTINCT year(o_orderdate))) AS years FROM orders GROUP BY 1""")
    # Repeats change neither count; beside an exact one in one step, the sketch would be kept once for every order.
    reg.add("D20_approx_count_distinct", lambda s, d: lineitem(s, d).select("l_returnflag", "l_orderkey").distinct().groupBy(
        "l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.count("l_orderkey").alias("e")).select(
        "l_returnflag", (F.abs(F.col("a") - F.col("e")) <= F.col("e") * 0.1).alias("is_near")),
        "SELECT DISTINCT l_returnflag, true AS is_near FROM lineitem")
    reg.add("D21_median_mode_quantiles", lambda s, d: lineitem(s, d).groupBy("l_returnflag").agg(
        F.median("l_quantity").alias("median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90_disc"),
        F.expr("percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity)").alias("p25_cont")), """
        SELECT l_returnflag, median(l_quantity) AS median, quantile_disc(l_quantity, 0.9) AS p90_disc,
               quantile_cont(l_quantity, 0.25) AS p25_cont FROM lineitem GROUP BY 1""")
    reg.add("D21_mode", lambda s, d: lineitem(s, d).groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").alias("n")).groupBy("l_returnflag").agg(
        F.max(F.struct("n", F.negative("l_linenumber").alias("neg"))).alias("m")).select(
        "l_returnflag", F.negative("m.neg").alias("most_common")), """
        SELECT l_returnflag, first(l_linenumber ORDER BY n DESC, l_linenumber) AS most_common FROM (
            SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
    reg.add("D22_statistics", lambda s, d: lineitem(s, d).groupBy("l_linestatus").agg(
        *[F.round(c, 6).alias(n) for n, c in {
            "sd": F.stddev_samp("l_quantity"), "var_p": F.var_pop("l_quantity"),
            "cor": F.corr("l_quantity", "l_extendedprice"), "cov": F.covar_pop("l_quantity", "l_discount"),
            "slope": F.regr_slope("l_extendedprice", "l_quantity")}.items()]), """
        SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var_p,
               round(corr(l_quantity, l_extendedprice), 6) AS cor, round(covar_pop(l_quantity, l_discount), 6) AS cov,
               round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY 1""")
    reg.add("D23_bit_and_bool_aggregates", lambda s, d: lineitem(s, d).groupBy("l_returnflag").agg(
        F.bit_and("l_partkey").alias("b_and"), F.bit_or("l_partkey").alias("b_or"), F.bit_xor("l_orderkey").alias("b_xor"),
        F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_discount") > 0.1).alias("any_high")), """
        SELECT l_returnflag, bit_and(l_partkey) AS b_and, bit_or(l_partkey) AS b_or, bit_xor(l_orderkey) AS b_xor,
               bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.1) AS any_high FROM lineitem GROUP BY 1""")

    def group_all(s, d):
        orders(s, d).createOrReplaceTempView("all_orders")
        return s.sql("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM all_orders
                        GROUP BY ALL HAVING count(*) > 3""")

    reg.add("D24_group_by_all_having", group_all, """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 3""")
    base = "o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY"
    for kind in ("rollup", "cube"):
        reg.add(f"D25_{kind}", lambda s, d, kind=kind: getattr(orders(s, d), kind)("o_orderstatus", "o_orderpriority").agg(
            F.count("*").alias("n")), f"SELECT {base} {kind.upper()} (o_orderstatus, o_orderpriority)")

    def sets(s, d):
        orders(s, d).createOrReplaceTempView("all_orders")
        return s.sql("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM all_orders
                        GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")

    reg.add("D25_grouping_sets", sets, f"SELECT {base} GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
    reg.add("D26_pivot", lambda s, d: orders(s, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(
        F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(f"st_{c.lower()}") for c in "FOP"]), """
        SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS st_f, count(*) FILTER (o_orderstatus = 'O') AS st_o,
               count(*) FILTER (o_orderstatus = 'P') AS st_p FROM orders GROUP BY 1""")
    reg.add("D26_unpivot", lambda s, d: lineitem(s, d).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").unpivot(
        ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "v").groupBy("measure").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("v") * 100).cast("long")).alias("total")), """
        SELECT measure, count(*) AS n, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS total FROM (
            UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax
            INTO NAME measure VALUE v) GROUP BY 1""")
    reg.add("D26_conditional_pivot", lambda s, d: lineitem(s, d).groupBy("l_linestatus").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity").cast("long")).otherwise(0)).alias(f"qty_{f.lower()}")
          for f in "ANR"]), """
        SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS qty_a,
               CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS qty_n,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS qty_r
        FROM lineitem GROUP BY 1""")


def _windows(reg: Registry):
    w, by_rev = day_window, lambda: Window.partitionBy("o_orderpriority").orderBy(F.desc("rev"), "day")
    rev_w = "PARTITION BY o_orderpriority ORDER BY rev DESC, day"
    n_w = "PARTITION BY o_orderpriority ORDER BY n"
    by_n = lambda: Window.partitionBy("o_orderpriority").orderBy("n")
    reg.add("D27_ranking", on_daily(
        ("rn", lambda: F.row_number().over(by_rev())), ("rk", lambda: F.rank().over(by_n())),
        ("dr", lambda: F.dense_rank().over(by_n())), ("quart", lambda: F.ntile(4).over(by_rev()))), daily_sql(
        ("rn", f"row_number() OVER ({rev_w})"), ("rk", f"rank() OVER ({n_w})"), ("dr", f"dense_rank() OVER ({n_w})"),
        ("quart", f"ntile(4) OVER ({rev_w})")))
    reg.add("D28_distribution", on_daily(
        ("pr", lambda: F.round(F.percent_rank().over(by_n()), 8)), ("cd", lambda: F.round(F.cume_dist().over(by_n()), 8))),
        daily_sql(("pr", f"round(percent_rank() OVER ({n_w}), 8)"), ("cd", f"round(cume_dist() OVER ({n_w}), 8)")))
    previous = lambda: F.lag("rev").over(w())
    reg.add("D29_lag_lead_change", on_daily(
        ("prev", previous), ("nxt", lambda: F.lead("rev").over(w())), ("change", lambda: F.col("rev") - previous()),
        ("pct", lambda: F.round((F.col("rev") - previous()) / previous(), 8)),
        ("gap_days", lambda: F.datediff("day", F.lag("day").over(w())))), daily_sql(
        ("prev", f"lag(rev) OVER ({DAY_W})"), ("nxt", f"lead(rev) OVER ({DAY_W})"),
        ("change", f"rev - lag(rev) OVER ({DAY_W})"),
        ("pct", f"round((rev - lag(rev) OVER ({DAY_W})) / lag(rev) OVER ({DAY_W}), 8)"),
        ("gap_days", f"day - lag(day) OVER ({DAY_W})")))

    def event_gaps(s, d):
        e = events(s, d).select("user_id", "event_id", "ts", "event_type")
        parts = OrderedParts(e, ["user_id"], ["ts", "event_id"])
        return parts.lag("prev_ts", F.col("ts")).lag("prev_type", F.col("event_type")).result().select(
            "event_id", "prev_type",
            (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))).alias("gap_us"))

    reg.add("D29_lag_over_raw_events", event_gaps, """
        SELECT event_id, lag(event_type) OVER w AS prev_type, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
    full = lambda: w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    reg.add("D30_first_last_nth", on_daily(
        ("a", lambda: F.first("rev").over(full())), ("z", lambda: F.last("rev").over(full())),
        ("third", lambda: F.nth_value("rev", 3).over(full()))), daily_sql(
        ("a", f"first_value(rev) OVER ({DAY_W} {frame})"), ("z", f"last_value(rev) OVER ({DAY_W} {frame})"),
        ("third", f"nth_value(rev, 3) OVER ({DAY_W} {frame})")))
    reg.add("D31_running_and_moving", on_daily(
        ("total", lambda: F.sum("rev").over(w().rowsBetween(Window.unboundedPreceding, 0))),
        ("avg7", lambda: F.round(F.avg("rev").over(w().rowsBetween(-6, 0)), 6))), daily_sql(
        ("total", f"CAST(sum(rev) OVER ({DAY_W} ROWS UNBOUNDED PRECEDING) AS BIGINT)"),
        ("avg7", f"round(avg(rev) OVER ({DAY_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)")))

    def running(s, d):
        e = events(s, d).select("user_id", "event_id", "ts", cents("value").alias("v"))
        return OrderedParts(e, ["user_id"], ["ts", "event_id"]).running_sum("total", F.col("v")).result().select(
            "event_id", "total")

    reg.add("D31_running_total_over_raw_events", running, """
        SELECT event_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY user_id
               ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events""")
    number = lambda: Window.partitionBy("o_orderpriority").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date")))
    reg.add("D32_range_frame", on_daily(
        ("sum30", lambda: F.sum("rev").over(number().rangeBetween(-29, 0)))), daily_sql(
        ("sum30", f"CAST(sum(rev) OVER ({DAY_W} RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT)")))
    reg.add("D33_centred_expanding_share", on_daily(
        ("centred", lambda: F.sum("rev").over(w().rowsBetween(-3, 3))),
        ("best", lambda: F.max("rev").over(w().rowsBetween(Window.unboundedPreceding, 0))),
        ("share", lambda: F.round(F.col("rev") / F.sum("rev").over(Window.partitionBy("o_orderpriority")), 10))), daily_sql(
        ("centred", f"CAST(sum(rev) OVER ({DAY_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT)"),
        ("best", f"max(rev) OVER ({DAY_W} ROWS UNBOUNDED PRECEDING)"),
        ("share", "round(rev / sum(rev) OVER (PARTITION BY o_orderpriority), 10)")))

    def against_median(s, d):
        li = lineitem(s, d)
        med = li.groupBy("l_returnflag").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("med"))
        return li.join(med, "l_returnflag").groupBy("l_returnflag", "med").agg(
            F.count_if(F.col("l_quantity") > F.col("med")).alias("above"))

    reg.add("D34_percentile_per_group", against_median, """
        SELECT l_returnflag, med, count(*) FILTER (l_quantity > med) AS above FROM (
            SELECT l_returnflag, l_quantity, median(l_quantity) OVER (PARTITION BY l_returnflag) AS med FROM lineitem)
        GROUP BY ALL""")
    reg.add("D35_windowed_filter", on_daily(
        ("busy", lambda: F.sum(F.when(F.col("n") > 1, F.col("rev")).otherwise(0)).over(
            w().rowsBetween(Window.unboundedPreceding, 0)))), daily_sql(
        ("busy", f"CAST(coalesce(sum(rev) FILTER (n > 1) OVER ({DAY_W} ROWS UNBOUNDED PRECEDING), 0) AS BIGINT)")))
    reg.add("D36_sessions", lambda s, d: sessions(
        events(s, d).select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 6 * 3600).groupBy(
        "user_id", "session_no").agg(F.count("*").alias("n")), """
        SELECT user_id, session_no, count(*) AS n FROM (
            SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
                SELECT *, CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM (
                    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)))
        GROUP BY ALL""")

    def newest(s, d):
        keep = lambda c: F.max_by(c, F.struct("ts", "event_id")).alias(c)
        return events(s, d).groupBy("user_id", "event_type").agg(keep("event_id"), keep("value"))

    reg.add("D37_qualify_latest_per_key", newest, """
        SELECT user_id, event_type, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")

    def spine(s, d):
        day = daily(s, d)
        bounds = orders(s, d).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
        full_grid = day.select("o_orderpriority").distinct().join(bounds, F.lit(True)).select(
            "o_orderpriority", F.explode(F.expr("sequence(a, b)")).alias("day"))
        return full_grid.join(day, ["o_orderpriority", "day"], "left").select(
            "o_orderpriority", "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rev", F.lit(0)).alias("rev"))

    reg.add("D38_date_spine", spine, f"""
        SELECT p AS o_orderpriority, CAST(x.d AS VARCHAR) AS day, coalesce(n, 0) AS n, coalesce(rev, 0) AS rev FROM (
            SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders) x
        CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)
        LEFT JOIN {DAILY} q ON q.day = x.d AND q.o_orderpriority = p""")

    def yoy(s, d):
        m = monthly(s, d)
        before = m.select(
            F.concat((F.substring("month", 1, 4).cast("int") + 1).cast("string"), F.substring("month", 5, 3)).alias("month"),
            F.col("rev").alias("last_year"))
        return m.join(before, "month").select(
            "month", "rev", "last_year", F.round(F.col("rev") / F.col("last_year") - 1, 8).alias("growth"))

    reg.add("D39_year_over_year", yoy, f"""
        SELECT month, rev, last_year, round(rev / last_year - 1, 8) AS growth FROM (
            SELECT a.month, a.rev, b.rev AS last_year FROM {MONTHLY} a JOIN {MONTHLY} b
            ON CAST(substr(a.month, 1, 4) AS INTEGER) = CAST(substr(b.month, 1, 4) AS INTEGER) + 1
               AND substr(a.month, 6) = substr(b.month, 6))""")

    def transformed(s, d):
        o = orders(s, d).select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("c"))
        g = o.groupBy("o_orderstatus").agg(
            F.avg("c").alias("m"), F.stddev_samp("c").alias("sd"), F.sum("c").alias("total"))
        return o.join(g, "o_orderstatus").select(
            "o_orderkey", F.round((F.col("c") - F.col("m")) / F.col("sd"), 6).alias("z"),
            F.round(F.col("c") / F.col("total"), 12).alias("share"))

    reg.add("D40_group_transform", transformed, """
        SELECT o_orderkey, round((c - avg(c) OVER w) / stddev_samp(c) OVER w, 6) AS z, round(c / sum(c) OVER w, 12) AS share
        FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders)
        WINDOW w AS (PARTITION BY o_orderstatus)""")

    def whole_groups(s, d):
        o = orders(s, d)
        keep = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m")).filter(
            "n >= 8 and m > 400000")
        return o.join(keep.select("o_custkey"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")

    reg.add("D41_keep_whole_groups", whole_groups, """
        SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
            SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8 AND max(o_totalprice) > 400000)""")

    def filled(s, d):
        k = F.col("event_id")
        e = events(s, d).select(
            "user_id", k, "ts", F.when(k % 4 != 0, cents("value")).alias("v"))
        mean = e.agg(F.avg("v").alias("m"))
        return OrderedParts(e, ["user_id"], ["ts", "event_id"]).forward_fill("ffill", F.col("v")).result().join(
            mean, F.lit(True)).select(
            k, F.coalesce("v", F.lit(0)).alias("const"), "ffill",
            F.round(F.coalesce(F.col("v").cast("double"), F.col("m")), 4).alias("mean_fill"))

    reg.add("D42_fill_missing", filled, """
        SELECT event_id, coalesce(v, 0) AS const, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
               ROWS UNBOUNDED PRECEDING) AS ffill, round(coalesce(CAST(v AS DOUBLE), avg(v) OVER ()), 4) AS mean_fill
        FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS v FROM events)""")

    def interpolated(s, d):
        series = daily(s, d).withColumn("x", F.datediff("day", F.lit("1970-01-01").cast("date"))).withColumn(
            "v", F.when(F.col("x") % 3 != 0, F.col("rev")))
        known = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
        back = w().rowsBetween(Window.unboundedPreceding, 0)
        ahead = w().rowsBetween(0, Window.unboundedFollowing)
        p, q = F.last(known, True).over(back), F.first(known, True).over(ahead)
        return series.select("o_orderpriority", "day", "x", "v", p.alias("p"), q.alias("q")).select(
            "o_orderpriority", "day", F.round(F.when(F.col("v").isNotNull(), F.col("v").cast("double")).otherwise(
                F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("x") - F.col("p.x")) / (F.col("q.x") - F.col("p.x"))), 4
            ).alias("v"))

    reg.add("D42_interpolate", interpolated, f"""
        SELECT o_orderpriority, CAST(s.day AS VARCHAR) AS day, round(CASE WHEN v IS NOT NULL THEN CAST(v AS DOUBLE)
               ELSE pv + (qv - pv) * (x - px) / (qx - px) END, 4) AS v FROM (
            SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(kx IGNORE NULLS) OVER b AS px,
                   first_value(v IGNORE NULLS) OVER f AS qv, first_value(kx IGNORE NULLS) OVER f AS qx FROM (
                SELECT *, CASE WHEN v IS NOT NULL THEN x END AS kx FROM (
                    SELECT *, CASE WHEN x % 3 <> 0 THEN rev END AS v FROM (
                        SELECT *, day - DATE '1970-01-01' AS x FROM {DAILY})))
            WINDOW b AS ({DAY_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   f AS ({DAY_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) s""")
    reg.add("D43_duplicate_removal", lambda s, d: events(s, d).groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("keep_first"), F.max("event_id").alias("keep_last"),
        F.when(F.count("*") == 1, F.min("event_id")).alias("keep_none")), """
        SELECT user_id, event_type, min(event_id) AS keep_first, max(event_id) AS keep_last,
               CASE WHEN count(*) = 1 THEN min(event_id) END AS keep_none FROM events GROUP BY ALL""")


def _shapes(reg: Registry):
    a = lambda s, d: customer(s, d).select(F.col("c_custkey").alias("custkey"))
    b = lambda s, d: orders(s, d).select(F.col("o_custkey").alias("custkey"))
    sa, sb = "SELECT c_custkey AS custkey FROM customer", "SELECT o_custkey AS custkey FROM orders"
    for name, fn, op in (
        ("union", lambda s, d: a(s, d).union(b(s, d)).distinct(), "UNION"),
        ("union_all", lambda s, d: a(s, d).union(b(s, d)), "UNION ALL"),
        ("intersect", lambda s, d: a(s, d).intersect(b(s, d)), "INTERSECT"),
        ("except", lambda s, d: a(s, d).subtract(b(s, d)), "EXCEPT"),
    ):
        reg.add(f"D44_{name}", fn, f"{sa} {op} {sb}")
    reg.add("D45_union_by_name", lambda s, d: nation(s, d).select(F.col("n_name").alias("name"), "n_regionkey").unionByName(
        region(s, d).select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"), F.lit(1).alias("is_region")),
        allowMissingColumns=True), """
        SELECT n_name AS name, n_regionkey FROM nation
        UNION ALL BY NAME SELECT r_regionkey AS n_regionkey, r_name AS name, 1 AS is_region FROM region""")

    def hierarchy(s, d):
        """Customers under the customer whose key is a tenth of theirs; one join per level."""
        c = customer(s, d).select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 10).alias("parent"))
        edges = cut(c.filter("id <> parent"), "edges")
        level = c.filter("id = 0").select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("root"))
        found, depth = level, 0
        while True:
            depth += 1
            level = cut(edges.join(level.select(F.col("id").alias("parent"), "root"), "parent").select(
                "id", F.lit(depth).alias("depth"), "root"), "level")
            if level.isEmpty():
                return found
            found = found.unionByName(level)

    reg.add("D47_recursive_hierarchy", hierarchy, """
        WITH RECURSIVE h AS (
            SELECT c_custkey AS id, 0 AS depth, CAST(0 AS BIGINT) AS root FROM customer WHERE c_custkey = 0
            UNION ALL SELECT c.c_custkey, depth + 1, root FROM customer c JOIN h ON c.c_custkey // 10 = h.id
            WHERE c.c_custkey <> 0)
        SELECT id, depth, root FROM h""")

    def cohorts(s, d):
        month = lambda c: F.trunc(F.to_date(c), "month")
        act = orders(s, d).select("o_custkey", month("o_orderdate").alias("m")).distinct()
        first = act.groupBy("o_custkey").agg(F.min("m").alias("cohort"))
        size = first.groupBy("cohort").agg(F.count("*").alias("cohort_size"))
        age = (F.year("m") - F.year("cohort")) * 12 + F.month("m") - F.month("cohort")
        live = act.join(first, "o_custkey").groupBy("cohort", age.alias("months")).agg(F.count("*").alias("active"))
        return live.join(size, "cohort").select(
            "cohort", "months", "cohort_size", "active", F.round(F.col("active") / F.col("cohort_size") * 100, 6).alias("pct"))

    reg.add("D53_cohort_retention", cohorts, """
        WITH act AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
             f AS (SELECT o_custkey, min(m) AS cohort FROM act GROUP BY 1),
             size AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1)
        SELECT CAST(q.cohort AS VARCHAR) AS cohort, months, cohort_size, active, round(active / cohort_size * 100, 6) AS pct FROM (
            SELECT cohort, datediff('month', cohort, m) AS months, count(*) AS active FROM act JOIN f USING (o_custkey)
            GROUP BY ALL) q JOIN size USING (cohort)""")

    def incremental(s, d):
        path = new_path(s, "incremental")
        o = orders(s, d).select("o_orderkey", "o_orderdate", "o_totalprice")
        early = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
        early.write.parquet(path)
        have = s.read.parquet(path).agg(F.max("o_orderdate").alias("high"))
        fresh = o.join(have, F.col("o_orderdate") > F.col("high")).drop("high")
        fresh.write.mode("append").parquet(path)
        return s.read.parquet(path).groupBy(F.year("o_orderdate").alias("yr")).agg(
            F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("rev"))

    reg.add("D54_incremental_append", incremental, """
        SELECT year(o_orderdate) AS yr, count(*) AS n,
               CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS rev FROM orders GROUP BY 1""")

    def delete_insert(s, d):
        old = orders(s, d).select("o_orderkey", cents("o_totalprice").alias("c"))
        new = old.filter("o_orderkey % 4 = 0").withColumn("c", F.col("c") + 5)
        return old.join(new.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(new)

    reg.add("D54_delete_and_insert", delete_insert, """
        SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 0 END AS c
        FROM orders""")

    def rebuild(s, d):
        path = new_path(s, "rebuild")
        day = daily(s, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("rev").alias("rev"))
        month = F.substring("day", 1, 7)
        day.withColumn("rev", F.lit(0).cast("long")).withColumn("month", month).write.partitionBy("month").parquet(path)
        newest = day.agg(F.max(month).alias("month"))
        again = day.withColumn("month", month).join(newest, "month")
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        return s.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.sum("rev").alias("rev"))

    reg.add("D54_rebuild_last_period", rebuild, f"""
        SELECT month, CASE WHEN month = max(month) OVER () THEN rev ELSE 0 END AS rev FROM {MONTHLY}""")

    def star(s, d):
        o, c = orders(s, d), customer(s, d)
        dates = o.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).select(
            F.explode(F.expr("sequence(a, b)")).alias("day")).select(
            F.date_format("day", "yyyyMMdd").cast("int").alias("date_key"), F.quarter("day").alias("q"), F.year("day").alias("yr"))
        dim = c.select(F.col("c_custkey").alias("customer_key"), "c_mktsegment")
        fact = o.select(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"),
                        F.col("o_custkey").alias("customer_key"), cents("o_totalprice").alias("c"))
        return fact.join(dates, "date_key").join(dim, "customer_key").groupBy("yr", "q", "c_mktsegment").agg(F.sum("c").alias("rev"))

    reg.add("D60_star_schema", star, """
        SELECT year(o_orderdate) AS yr, quarter(o_orderdate) AS q, c_mktsegment,
               CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS rev
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")

    def attribution(s, d):
        e = events(s, d).withColumn("tag", F.concat(F.lit("team="), "event_type", F.lit(";user="), F.col("user_id").cast("string")))
        team = F.regexp_extract("tag", "team=([a-z]+)", 1)
        user = F.split_part("tag", F.lit("user="), F.lit(2))
        sums = e.groupBy(team.alias("team")).agg(F.sum(cents("value")).alias("used"), F.countDistinct(user).alias("users"))
        total = sums.agg(F.sum("used").alias("total"))
        return sums.join(total, F.lit(True)).select(
            "team", "used", "users", F.round(F.col("used") / F.col("total"), 8).alias("share"))

    reg.add("D61_usage_attribution", attribution, """
        SELECT event_type AS team, used, users, round(used / sum(used) OVER (), 8) AS share FROM (
            SELECT event_type, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS used,
                   count(DISTINCT user_id) AS users FROM events GROUP BY 1)""")

    def allocated(s, d):
        use = customer(s, d).groupBy("c_nationkey").agg(F.count("*").alias("n"))
        cost = region(s, d).agg((F.sum("r_regionkey") * 1000 + 500).alias("shared"), F.count("*").alias("regions"))
        total = use.agg(F.sum("n").alias("total"), F.count("*").alias("teams"))
        return use.join(total, F.lit(True)).join(cost, F.lit(True)).select(
            "c_nationkey", F.round(F.col("shared") / F.col("teams"), 6).alias("equal_share"),
            F.round(F.col("shared") * F.col("n") / F.col("total"), 6).alias("by_use"),
            F.round(F.col("shared") * F.col("n") / F.col("total") / F.col("n"), 6).alias("unit_cost"))

    reg.add("D62_shared_cost_allocation", allocated, """
        SELECT c_nationkey, round(shared / count(*) OVER (), 6) AS equal_share, round(shared * n / sum(n) OVER (), 6) AS by_use,
               round(shared * n / sum(n) OVER () / n, 6) AS unit_cost
        FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
             (SELECT CAST(sum(r_regionkey) * 1000 + 500 AS DOUBLE) AS shared FROM region)""")

    def json_ops(s, d):
        m = F.from_json("props", "map<string,string>")
        merged = F.map_concat(m, F.create_map(F.lit("type"), F.col("event_type"), F.lit("drop"), F.lit("x")))
        left = F.map_filter(F.col("merged"), lambda k, v: k != "drop")
        return events(s, d).select("event_id", m.alias("m"), merged.alias("merged")).select(
            "event_id", F.map_contains_key("m", "k").alias("has_k"),
            (F.map_contains_key("m", "k") & F.map_contains_key("m", "zz")).alias("has_all"),
            (F.map_contains_key("m", "k") | F.map_contains_key("m", "zz")).alias("has_any"),
            (F.element_at("m", "k") == "7").alias("contains_k7"), F.element_at(left, "type").alias("type"),
            F.array_join(F.sort_array(F.map_keys(left)), ",").alias("keys"))

    reg.add("D63_json_operations", json_ops, """
        SELECT event_id, true AS has_k, false AS has_all, true AS has_any, json_contains(props, '{"k": 7}') AS contains_k7,
               event_type AS type, 'k,type' AS keys FROM events""")
    reg.add("D64_filter_sort_rename", lambda s, d: part(s, d).filter(
        F.col("p_type").isin("ECONOMY", "STANDARD") & (F.col("p_size") > 10) & ~F.col("p_name").contains("red")
    ).withColumnRenamed("p_brand", "brand").drop("p_retailprice").select("brand", "p_partkey", "p_size").orderBy(
        F.desc("p_size"), "brand", "p_partkey"), """
        SELECT p_brand AS brand, p_partkey, p_size FROM part
        WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_size > 10 AND NOT contains(p_name, 'red')""")

    def cleaned(s, d):
        raw = customer(s, d).select("c_custkey", F.concat(
            F.lit("  jOHN   "), F.lower("c_mktsegment"), F.lit(" ")).alias("name"), F.when(
            F.col("c_custkey") % 3 == 0, F.lit("bad.address")).otherwise(F.concat(
                F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@Mail.example.com"))).alias("email"))
        tidy = F.initcap(F.trim(F.regexp_replace("name", r"\s+", " ")))
        return raw.select(
            "c_custkey", tidy.alias("name"), F.lower("email").rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$").alias("is_email"),
            F.regexp_extract(F.lower("email"), "@(.+)$", 1).alias("domain"), F.split(tidy, " ")[0].alias("first_name"),
            F.element_at(F.split(tidy, " "), -1).alias("last_name"))

    reg.add("D65_string_cleaning", cleaned, """
        SELECT c_custkey, 'John ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name, c_custkey % 3 <> 0 AS is_email,
               CASE WHEN c_custkey % 3 <> 0 THEN 'mail.example.com' ELSE '' END AS domain, 'John' AS first_name,
               upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS last_name FROM customer""")


def _checks(reg: Registry):
    reg.add("D49_profile", lambda s, d: quality.profile(orders(s, d).select("o_orderkey", "o_custkey", "o_orderstatus")).select(
        "column_name", "non_null", "nulls", "min", "max"), """
        SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS non_null, count(*) - count(o_orderkey) AS nulls,
               CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders
        UNION ALL SELECT 'o_custkey', count(o_custkey), count(*) - count(o_custkey), CAST(min(o_custkey) AS VARCHAR),
               CAST(max(o_custkey) AS VARCHAR) FROM orders
        UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(*) - count(o_orderstatus), min(o_orderstatus),
               max(o_orderstatus) FROM orders""")

    def pair(s, d):
        src = orders(s, d).select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, cents("o_totalprice")).alias("c"))
        k = F.col("o_orderkey")
        tgt = src.withColumn("c", F.when(k % 13 == 0, F.coalesce("c", F.lit(0)) + 1).when(k % 17 == 0, F.lit(None)).otherwise(F.col("c")))
        return src, tgt

    changed = """SELECT o_orderkey FROM (SELECT o_orderkey, c, CASE WHEN o_orderkey % 13 = 0 THEN coalesce(c, 0) + 1
        WHEN o_orderkey % 17 = 0 THEN NULL ELSE c END AS t FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0
        THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS c FROM orders)) WHERE c IS DISTINCT FROM t"""
    reg.add("D51_changed_rows_by_hash", lambda s, d: quality.changed_rows(*pair(s, d), "o_orderkey", ["o_orderstatus", "c"]), changed)

    def null_safe(s, d):
        src, tgt = pair(s, d)
        return src.join(tgt.select("o_orderkey", F.col("c").alias("t")), "o_orderkey").filter(
            ~F.col("c").eqNullSafe(F.col("t"))).select("o_orderkey")

    reg.add("D51_changed_rows_null_safe", null_safe, changed)

    def migration(s, d):
        src, tgt = pair(s, d)
        return quality.run_checks({
            "target_keys_unique": quality.not_unique(tgt, "o_orderkey"),
            "lost_keys": quality.key_differences(src, tgt, "o_orderkey"), "null_amounts": quality.nulls(tgt, "c")})

    reg.add("D50_migration_checks", migration, """
        SELECT 'target_keys_unique' AS check_name, 0 AS violations UNION ALL SELECT 'lost_keys', 0
        UNION ALL SELECT 'null_amounts', count(*) FILTER (o_orderkey % 13 <> 0 AND (o_orderkey % 17 = 0 OR o_orderkey % 7 = 0))
        FROM orders""")

    def counters(s, d):
        c = customer(s, d).select(
            F.when(F.col("c_custkey") % 9 != 0, F.floor(F.col("c_custkey") / 2)).alias("k"), "c_acctbal")
        return quality.quality_counters(c, "k", "c_acctbal")

    reg.add("D55_quality_counters", counters, """
        WITH q AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey // 2 END AS k, c_acctbal FROM customer)
        SELECT count(*) - count(k) AS null_keys, count(*) FILTER (c_acctbal < 0) AS negative_amounts,
               (SELECT count(*) FROM (SELECT k FROM q WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)) AS duplicate_keys
        FROM q""")
    reg.add("D66_validation_summary", lambda s, d: quality.validation_summary(
        part(s, d).select("p_brand", "p_size", F.when(F.col("p_size") > 5, F.col("p_type")).alias("p_type")),
        {"p_size": (1, 40)}), """
        SELECT count(*) AS rows, 0 AS p_brand_nulls, 0 AS p_size_nulls, count(*) FILTER (p_size <= 5) AS p_type_nulls,
               count(*) FILTER (p_size NOT BETWEEN 1 AND 40) AS p_size_out_of_range,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_size,
                   CASE WHEN p_size > 5 THEN p_type END FROM part)) AS repeated_rows FROM part""")
