"""Registered queries: scalar functions and geometry (K, D67)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import geo
from tallyforge.registry.core import Registry
from tallyforge.sources import tables as t


def _part(s, d, **cols):
    return t.table(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in cols.items()])


def _event(s, d, **cols):
    return t.table(s, d, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


def _points(s, d):
    """Orders as points: a position from price and customer."""
    return t.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919) % 100_003 / 1000.0).alias("x"),
        ((F.col("o_orderkey") * 104_729) % 100_019 / 1000.0).alias("y"))


POINTS = """(SELECT o_orderkey AS id, (o_orderkey * 7919) % 100003 / 1000.0 AS x, (o_orderkey * 104729) % 100019 / 1000.0 AS y
    FROM orders)"""


def _places(s, d):
    return t.table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 10_007 / 10_007.0 + 12.0).alias("lat"),
        ((F.col("c_custkey") * 104_729) % 10_009 / 10_009.0 + 77.0).alias("lng"))


def _sites(s, d):
    return t.table(s, d, "supplier").select(
        F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 31) % 101 / 101.0 + 12.0).alias("lat"),
        ((F.col("s_suppkey") * 57) % 103 / 103.0 + 77.0).alias("lng"))


def register(reg: Registry):
    c = F.col
    pad = lambda: F.concat(F.lit("  "), c("p_name"), F.lit(" "))
    reg.add("K1_length_case_trim", lambda s, d: _part(
        s, d, n=F.length("p_name"), up=F.upper("p_name"), low=F.lower("p_brand"), t=F.trim(pad()), l=F.ltrim(pad()),
        r=F.rtrim(pad())), """
        SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS up, lower(p_brand) AS low,
               trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r FROM part""")
    reg.add("K2_substrings", lambda s, d: _part(
        s, d, sub=F.substring("p_name", 2, 4), lft=F.left("p_name", F.lit(3)), rgt=F.right("p_name", F.lit(3)),
        rep=F.replace("p_name", F.lit("red"), F.lit("R")), has=F.contains("p_name", F.lit("ring")),
        st=F.startswith("p_name", F.lit("small")), en=F.endswith("p_name", F.lit("t"))), """
        SELECT p_partkey, substr(p_name, 2, 4) AS sub, left(p_name, 3) AS lft, right(p_name, 3) AS rgt,
               replace(p_name, 'red', 'R') AS rep, contains(p_name, 'ring') AS has, starts_with(p_name, 'small') AS st,
               ends_with(p_name, 't') AS en FROM part""")
    reg.add("K3_build_strings", lambda s, d: _part(
        s, d, cat=F.concat("p_brand", F.lit("/"), "p_type"), fmt=F.format_string("%s:%05d", "p_type", "p_size"),
        lp=F.lpad("p_type", 12, "."), rp=F.rpad("p_type", 12, "."), rep=F.repeat("p_type", 2), rev=F.reverse("p_name")), """
        SELECT p_partkey, concat(p_brand, '/', p_type) AS cat, printf('%s:%05d', p_type, p_size) AS fmt,
               lpad(p_type, 12, '.') AS lp, rpad(p_type, 12, '.') AS rp, repeat(p_type, 2) AS rep, reverse(p_name) AS rev FROM part""")
    reg.add("K4_split", lambda s, d: _part(
        s, d, second=F.split_part("p_name", F.lit(" "), F.lit(2)), n=F.size(F.split("p_name", " ")),
        dots=F.array_join(F.split(F.concat("p_brand", F.lit("."), "p_type"), r"\."), "+")), """
        SELECT p_partkey, split_part(p_name, ' ', 2) AS second, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n,
               array_to_string(string_split(p_brand || '.' || p_type, '.'), '+') AS dots FROM part""")
    # Only the first occurrence: the rest of the text is captured and put back.
    reg.add("K5_regexp", lambda s, d: _part(
        s, d, first_only=F.regexp_replace("p_name", "^(.*?)[aeiou](.*)$", "$1*$2"),
        every=F.regexp_replace("p_name", "[aeiou]", "*"), hit=F.col("p_name").rlike("^[a-m]"),
        num=F.regexp_extract("p_brand", r"(\d+)", 1), pieces=F.size(F.split("p_name", "[ e]"))), r"""
        SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS first_only, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every,
               regexp_matches(p_name, '^[a-m]') AS hit, regexp_extract(p_brand, '(\d+)', 1) AS num,
               CAST(len(regexp_split_to_array(p_name, '[ e]')) AS INTEGER) AS pieces FROM part""")
    v = lambda: c("value") - 200
    reg.add("K6_numeric", lambda s, d: _event(
        s, d, a=F.abs(v()), ce=F.ceil(v()), fl=F.floor(v()), ro=F.round(c("value").cast("decimal(10,2)"), 1),
        tr=(F.signum(v()) * F.floor(F.abs(v()))).cast("long"), ln=F.round(F.ln("value"), 8),
        l10=F.round(F.log10("value"), 8), l2=F.round(F.log2("value"), 8), po=F.round(F.pow("value", F.lit(1.5)), 4),
        sq=F.round(F.sqrt("value"), 8), mo=c("event_id") % 7, sg=F.signum(v()).cast("int"),
        gr=F.greatest("value", F.lit(100.0)), le=F.least("value", F.lit(100.0))), """
        SELECT event_id, abs(value - 200) AS a, CAST(ceil(value - 200) AS BIGINT) AS ce, CAST(floor(value - 200) AS BIGINT) AS fl,
               CAST(round(CAST(value AS DECIMAL(10,2)), 1) AS DOUBLE) AS ro, CAST(trunc(value - 200) AS BIGINT) AS tr,
               round(ln(value), 8) AS ln, round(log10(value), 8) AS l10, round(log2(value), 8) AS l2,
               round(power(value, 1.5), 4) AS po, round(sqrt(value), 8) AS sq, event_id % 7 AS mo, sign(value - 200) AS sg,
               greatest(value, 100.0) AS gr, least(value, 100.0) AS le FROM events""")
    reg.add("K7_random", lambda s, d: t.table(s, d, "events").select(F.rand(42).alias("r")).agg(
        F.min("r").between(0, 1).alias("low_ok"), F.max("r").between(0, 1).alias("high_ok")),
        "SELECT true AS low_ok, true AS high_ok FROM events LIMIT 1")
    reg.add("K8_date_parts", lambda s, d: t.table(s, d, "events").select(
        "event_id", (F.current_date() >= F.to_date("ts")).alias("past"), F.date_part(F.lit("year"), "ts").alias("y"),
        F.extract(F.lit("month"), "ts").alias("m"), F.dayofmonth("ts").alias("dd"), F.hour("ts").alias("h"),
        F.minute("ts").alias("mi"), F.weekofyear("ts").alias("w"), F.quarter("ts").alias("q")), """
        SELECT event_id, true AS past, year(ts) AS y, extract(month FROM ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi,
               week(ts) AS w, quarter(ts) AS q FROM events""")
    day = lambda: F.to_date("o_orderdate")
    reg.add("K9_date_arithmetic", lambda s, d: t.table(s, d, "orders").select(
        "o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), day()).alias("days"), F.date_add(day(), 10).alias("later"),
        F.add_months(day(), -2).alias("earlier"), F.trunc(day(), "quarter").alias("quarter"),
        F.make_date(F.year(day()), F.lit(1), F.lit(15)).alias("made")), """
        SELECT o_orderkey, DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS days, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later,
               CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS earlier,
               CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter,
               CAST(make_date(year(o_orderdate), 1, 15) AS VARCHAR) AS made FROM orders""")

    def age(s, d):
        """Whole years and months up to a day, and the days that are left."""
        end = F.lit("2002-03-31").cast("date")
        months = F.floor(F.months_between(end, day())).cast("int")
        rest = F.datediff(end, F.add_months(day(), months))
        return t.table(s, d, "orders").select(
            "o_orderkey", F.floor(months / 12).cast("int").alias("years"), (months % 12).alias("months"), rest.alias("days"))

    reg.add("K10_age", age, """
        SELECT o_orderkey, m // 12 AS years, m % 12 AS months, DATE '2002-03-31' - CAST(d + to_months(CAST(m AS INTEGER)) AS DATE) AS days
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, datesub('month', CAST(o_orderdate AS DATE), DATE '2002-03-31') AS m
              FROM orders)""")
    stamp = lambda: c("ts").cast("timestamp")
    reg.add("K11_format_parse_epoch", lambda s, d: t.table(s, d, "events").select(
        "event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("shown"), F.unix_seconds(stamp()).alias("sec"),
        F.round(F.unix_micros(stamp()) / 1000).cast("long").alias("ms"),
        F.date_format(F.try_to_timestamp(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit("dd/MM/yyyy HH:mm")), "yyyy-MM-dd HH:mm:ss").alias("back"),
        F.date_format(F.timestamp_seconds(F.unix_seconds(stamp())), "yyyy-MM-dd HH:mm:ss").alias("from_epoch")), """
        SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS sec, epoch_ms(ts) AS ms,
               strftime(strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M'), '%Y-%m-%d %H:%M:%S') AS back,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_epoch FROM events""")
    doc = lambda: F.to_json(F.struct(c("props").alias("raw"), F.array("event_type", F.lit("z")).alias("tags"), c("user_id").alias("u")))
    reg.add("K12_json", lambda s, d: t.table(s, d, "events").select("event_id", "props", doc().alias("j")).select(
        "event_id", F.get_json_object("j", "$.u").cast("long").alias("u"), F.json_array_length(F.get_json_object("j", "$.tags")).alias("n"),
        F.array_join(F.json_object_keys("j"), ",").alias("keys"), F.try_parse_json("props").isNotNull().alias("valid"),
        F.try_parse_json(F.concat(F.lit("{"), "props")).isNotNull().alias("broken"),
        F.get_json_object("j", "$.tags[0]").alias("tag"), F.schema_of_variant(F.parse_json(F.get_json_object("j", "$.u"))).alias("kind")), """
        SELECT event_id, CAST(j ->> '$.u' AS BIGINT) AS u, CAST(json_array_length(j, '$.tags') AS INTEGER) AS n,
               array_to_string(json_keys(j), ',') AS keys, json_valid(props) AS valid, json_valid('{' || props) AS broken,
               j ->> '$.tags[0]' AS tag, 'BIGINT' AS kind
        FROM (SELECT *, to_json({'raw': props, 'tags': [event_type, 'z'], 'u': user_id}) AS j FROM events)""")
    xs = lambda: F.array(c("l_linenumber"), c("l_quantity").cast("int"), (c("l_orderkey") % 10).cast("int"), c("l_linenumber"))
    base = "list_value(l_linenumber, CAST(l_quantity AS INTEGER), CAST(l_orderkey % 10 AS INTEGER), l_linenumber)"

    def listed(name, cols, sql):
        reg.add(name, lambda s, d: t.table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", xs().alias("xs")).select(
            "l_orderkey", "l_linenumber", "l_partkey", *[f().alias(n) for n, f in cols.items()]),
            f"SELECT l_orderkey, l_linenumber, l_partkey, {sql} FROM (SELECT *, {base} AS xs FROM lineitem)")

    text_of = lambda a: F.array_join(a, ",")
    listed("K13_list_build_and_sort", {
        "total": lambda: F.aggregate("xs", F.lit(0), lambda a, x: a + x), "sorted": lambda: text_of(F.sort_array("xs")),
        "back": lambda: text_of(F.sort_array("xs", asc=False)), "uniq": lambda: F.size(F.array_distinct("xs"))}, """
        CAST(list_sum(xs) AS INTEGER) AS total, array_to_string(list_sort(xs), ',') AS sorted,
        array_to_string(list_reverse_sort(xs), ',') AS back, CAST(list_unique(xs) AS INTEGER) AS uniq""")
    listed("K14_list_search_and_slice", {
        "has3": lambda: F.array_contains("xs", 3), "pos": lambda: F.array_position("xs", c("l_linenumber")).cast("int"),
        "both": lambda: text_of(F.concat("xs", F.array(F.lit(9)))), "mid": lambda: text_of(F.slice("xs", 2, 2)),
        "flat": lambda: F.size(F.flatten(F.array("xs", "xs")))}, """
        list_contains(xs, 3) AS has3, list_position(xs, l_linenumber) AS pos, array_to_string(list_concat(xs, [9]), ',') AS both,
        array_to_string(xs[2:3], ',') AS mid, CAST(len(flatten([xs, xs])) AS INTEGER) AS flat""")
    listed("K15_list_filter_transform_reduce", {
        "big": lambda: text_of(F.filter("xs", lambda x: x > 3)), "twice": lambda: text_of(F.transform("xs", lambda x: x * 2)),
        "product": lambda: F.aggregate("xs", F.lit(1).cast("long"), lambda a, x: a * (x + 1)),
        "odd_squares": lambda: text_of(F.transform(F.filter("xs", lambda x: x % 2 == 1), lambda x: x * x))}, """
        array_to_string(list_filter(xs, lambda x: x > 3), ',') AS big, array_to_string(list_transform(xs, lambda x: x * 2), ',') AS twice,
        CAST(list_product(list_transform(xs, lambda x: x + 1)) AS BIGINT) AS product,
        array_to_string([x * x FOR x IN xs IF x % 2 = 1], ',') AS odd_squares""")
    reg.add("K16_conditionals", lambda s, d: _part(
        s, d, size=F.when(c("p_size") > 30, "big").when(c("p_size") > 10, "mid").otherwise("small"),
        co=F.coalesce(F.when(c("p_size") > 25, c("p_brand")), c("p_type")), ifn=F.ifnull(F.nullif("p_type", F.lit("ECONOMY")), F.lit("none")),
        iif=F.expr("if(p_size % 2 = 0, 'even', 'odd')")), """
        SELECT p_partkey, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS size,
               coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS co, ifnull(nullif(p_type, 'ECONOMY'), 'none') AS ifn,
               if(p_size % 2 = 0, 'even', 'odd') AS iif FROM part""")
    reg.add("K17_maps", lambda s, d: _part(
        s, d, m=F.map_from_arrays(F.array(F.lit("brand"), F.lit("type")), F.array("p_brand", "p_type"))).select(
        "p_partkey", F.element_at("m", "brand").alias("brand"), F.size("m").alias("n"),
        F.array_join(F.map_keys("m"), ",").alias("keys")), """
        SELECT p_partkey, p_brand AS brand, CAST(cardinality(m) AS INTEGER) AS n, array_to_string(map_keys(m), ',') AS keys
        FROM (SELECT *, MAP {'brand': p_brand, 'type': p_type} AS m FROM part)""")

    hav = """2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2)
        + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2))))"""
    places = "(SELECT c_custkey AS id, (c_custkey * 7919) % 10007 / 10007.0 + 12.0 AS lat, (c_custkey * 104729) % 10009 / 10009.0 + 77.0 AS lng FROM customer)"
    sites = "(SELECT s_suppkey AS id, (s_suppkey * 31) % 101 / 101.0 + 12.0 AS lat, (s_suppkey * 57) % 103 / 103.0 + 77.0 AS lng FROM supplier)"
    reg.add("K18_radius_join", lambda s, d: geo.within_radius(_places(s, d), _sites(s, d), 8000.0).select(
        "l_id", "r_id", F.round("metres", 3).alias("metres")), f"""
        SELECT p.id AS l_id, s.id AS r_id, round({hav}, 3) AS metres FROM {places} p, {sites} s WHERE {hav} <= 8000""")

    def inside(s, d):
        side = t.table(s, d, "nation").select(
            c("n_nationkey").alias("polygon_id"), (c("n_nationkey") % 5 * 18.0).alias("x0"), (c("n_regionkey") * 19.0).alias("y0"))
        v = lambda dx, dy: F.struct((c("x0") + dx).alias("x"), (c("y0") + dy).alias("y"))
        ring = F.array(v(0.25, 0.25), v(11.25, 0.25), v(11.25, 9.75), v(5.75, 4.25), v(0.25, 9.75))
        return geo.points_in_polygons(_points(s, d), side.select("polygon_id", ring.alias("ring")), 5.0)

    reg.add("K19_points_in_polygons", inside, f"""
        SELECT id, polygon_id FROM (SELECT *, x - x0 AS u, y - y0 AS v FROM {POINTS} p, (
            SELECT n_nationkey AS polygon_id, n_nationkey % 5 * 18.0 AS x0, n_regionkey * 19.0 AS y0 FROM nation))
        WHERE u >= 0.25 AND u < 11.25 AND v > 0.25 AND v <= 9.75
          AND NOT (v > 4.25 AND u >= 0.25 + (v - 9.75) * 5.5 / -5.5 AND u < 11.25 + (v - 9.75) * -5.5 / -5.5)""")
    reg.add("K19_bounding_box", lambda s, d: _points(s, d).filter(geo.in_box(c("x"), c("y"), (10, 20, 40, 45))).select("id"),
            f"SELECT id FROM {POINTS} WHERE x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 45")
    reg.add("K20_cell_counts", lambda s, d: geo.cell_counts(_points(s, d), 2.5), f"""
        SELECT CAST(floor(x / 2.5) AS BIGINT) AS cx, CAST(floor(y / 2.5) AS BIGINT) AS cy, count(*) AS n FROM {POINTS} GROUP BY ALL""")

    def close(s, d):
        targets = t.table(s, d, "supplier").select(
            c("s_suppkey").alias("id"), (c("s_suppkey") * 7919 % 101 * 1.0).alias("x"), (c("s_suppkey") * 31 % 97 * 1.0).alias("y"))
        return geo.nearest(_points(s, d), targets, 3, 8.0).select("l_id", "r_id", "rank", F.round("distance", 6).alias("distance"))

    reg.add("D67_nearest_targets", close, f"""
        SELECT l_id, r_id, rank, round(dist, 6) AS distance FROM (
            SELECT p.id AS l_id, s.id AS r_id, sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)) AS dist,
                   row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2)), s.id) AS rank
            FROM {POINTS} p, (SELECT s_suppkey AS id, s_suppkey * 7919 % 101 * 1.0 AS x, s_suppkey * 31 % 97 * 1.0 AS y FROM supplier) s)
        WHERE rank <= 3""")
