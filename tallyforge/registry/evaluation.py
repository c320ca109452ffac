"""Registered queries: data preparation and evaluation recipes (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge.functions import stats
from tallyforge.plans import evaluation as ev
from tallyforge.plans import preparation as pr
from tallyforge.registry.core import Registry
from tallyforge.session import cut, spread
from tallyforge.sources import tables as t

K = 5
EXAMPLES = """(SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
TOKENS = r"(CASE WHEN trim({c}, E' \t\n\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}, E' \t\n\r'), '\s+')) END)"
VECTORS = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PARTS = "(SELECT p_brand AS q, p_partkey AS item, p_retailprice, p_size FROM part)"


def _examples(s, d) -> DataFrame:
    return pr.to_instructions(t.table(s, d, "conversations"))


def _parts(s, d) -> DataFrame:
    return t.table(s, d, "part").select(
        F.col("p_brand").alias("q"), F.col("p_partkey").alias("item"), "p_retailprice", "p_size", "p_name")


def _top(s, d, k=K) -> DataFrame:
    return ev.top_k(_parts(s, d), "q", [F.desc("p_retailprice"), "item"], k).select("q", "item", "rank")


TOP = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p_retailprice DESC, item) AS rank FROM {PARTS})
    WHERE rank <= {{k}})"""


def _vectors(s, d) -> DataFrame:
    return t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _arms(s, d) -> DataFrame:
    return t.table(s, d, "events").select(
        ev.variant("checkout", F.col("user_id"), 0.5).alias("arm"), (F.col("event_type") == "purchase").alias("bought"),
        "value", "user_id", "event_type")


ARM = "(CASE WHEN CAST('0x' || substr(md5('checkout:' || user_id), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.5 THEN 'treatment' ELSE 'control' END)"


def _labelled(s, d) -> DataFrame:
    docs = t.table(s, d, "documents").select("doc_id", "n_chars", "lang")
    return t.table(s, d, "labels").join(docs, "doc_id").withColumns({
        "guess": (F.col("n_chars") % 3 > 0).cast("int"), "other": (F.col("n_chars") % 5 > 1).cast("int")})


LABELLED = """(SELECT doc_id, quality, toxic, n_chars, lang, CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS guess,
    CASE WHEN n_chars % 5 > 1 THEN 1 ELSE 0 END AS other FROM labels JOIN documents USING (doc_id))"""


def _prices(s, d) -> DataFrame:
    return t.table(s, d, "lineitem").select(
        (F.col("l_quantity") - 10).alias("y"), (F.col("l_linenumber") * 6.0).alias("p"), "l_returnflag")


PRICES = "(SELECT l_quantity - 10 AS y, l_linenumber * CAST(6 AS DOUBLE) AS p, l_returnflag FROM lineitem)"


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, n).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def register(reg: Registry):
    tin, tout = TOKENS.format(c="instruction"), TOKENS.format(c="output")
    reg.add("V1_example_stats", lambda s, d: rounded(pr.example_stats(_examples(s, d))), f"""
        SELECT count(*) AS total_examples, round(avg(i), 6) AS avg_input_length, round(avg(o), 6) AS avg_output_length,
               max(i) AS max_input_length, max(o) AS max_output_length, count(*) FILTER (i = 0) AS empty_inputs,
               count(*) FILTER (o = 0) AS empty_outputs, count(*) FILTER (i + o > 4096) AS too_long,
               count(*) - count(DISTINCT instruction) AS duplicate_count
        FROM (SELECT *, {tin} AS i, {tout} AS o FROM {EXAMPLES})""")
    patterns = " OR ".join("regexp_matches(output, '" + p.replace("'", "''") + "', 'i')" for p in pr.REFUSALS)
    reg.add("V2_quality_filter", lambda s, d: pr.quality_filter(_examples(s, d)).select("conv_id", "turn"), f"""
        SELECT conv_id, turn FROM (SELECT *, {tin} AS i, {tout} AS o FROM {EXAMPLES})
        WHERE i BETWEEN 10 AND 2048 AND o BETWEEN 5 AND 2048 AND NOT ({patterns})""")
    reg.add("V3_exact_copies", lambda s, d: pr.drop_exact_copies(t.table(s, d, "documents"), "text", "doc_id").select("doc_id"),
            "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
    reg.add("V4_near_copies", lambda s, d: pr.drop_near_copies(t.table(s, d, "documents"), "doc_id", F.col("text")))
    reg.add("V5_stratified_split", lambda s, d: pr.stratified_split(t.table(s, d, "documents"), "doc_id", "lang"), """
        SELECT doc_id, lang, CASE WHEN rn <= round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'validation' ELSE 'train' END AS part FROM (
            SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn,
                   count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
    reg.add("V6_conversation_to_examples", _examples, f"SELECT * FROM {EXAMPLES}")
    reg.add("V6_examples_to_messages", lambda s, d: pr.to_messages(_examples(s, d), "Be brief."), f"""
        SELECT conv_id, turn, 0 AS position, 'system' AS role, 'Be brief.' AS content FROM {EXAMPLES}
        UNION ALL SELECT conv_id, turn, 1, 'user', instruction FROM {EXAMPLES}
        UNION ALL SELECT conv_id, turn, 2, 'assistant', output FROM {EXAMPLES}""")
    reg.add("V7_fixed_chunks", lambda s, d: spread(t.table(s, d, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(pr.fixed_chunks(F.col("text"))).alias("pos", "chunk")))
    reg.add("V8_sentence_chunks", lambda s, d: spread(t.table(s, d, "documents").select("doc_id", "text")).select(
        "doc_id", F.inline(pr.sentence_chunks(F.col("text")))), r"""
        SELECT doc_id, array_to_string(s[i + 1:i + 5], ' ') AS text, CAST(i AS INTEGER) AS start_sentence,
               CAST(least(i + 5, len(s)) - 1 AS INTEGER) AS end_sentence
        FROM (SELECT doc_id, s, unnest(range(0, len(s), 4)) AS i FROM (
            SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)),
                   lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '') AS s FROM documents))""")

    def metrics(s, d):
        relevant = _parts(s, d).filter("p_size > 25").select("q", "item")
        return rounded(ev.retrieval_metrics(_top(s, d), relevant, "q", "item", K))

    reg.add("V9_retrieval_metrics", metrics, f"""
        SELECT q, round(found / {K}, 6) AS precision_at_k, round(CASE WHEN n > 0 THEN found / n ELSE 0 END, 6) AS recall_at_k,
               CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, round(coalesce(1.0 / first, 0), 6) AS mrr FROM (
            SELECT q, count(*) FILTER (p_size > 25) AS found, min(rank) FILTER (p_size > 25) AS first FROM {TOP.format(k=K)} GROUP BY q)
        JOIN (SELECT q, count(*) FILTER (p_size > 25) AS n FROM {PARTS} GROUP BY q) USING (q)""")
    graded = lambda s, d: _parts(s, d).select("q", "item", (F.col("p_size") % 4).alias("rel"))
    reg.add("V10_ndcg", lambda s, d: rounded(ev.ndcg(_top(s, d), graded(s, d), "q", "item", "rel", K)), f"""
        SELECT q, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM (
            SELECT q, sum((p_size % 4) / log2(rank + 1)) AS dcg FROM {TOP.format(k=K)} GROUP BY q) JOIN (
            SELECT q, sum(rel / log2(r + 1)) AS ideal FROM (SELECT q, p_size % 4 AS rel,
                   row_number() OVER (PARTITION BY q ORDER BY p_size % 4 DESC, item) AS r FROM {PARTS}) WHERE r <= {K} GROUP BY q)
        USING (q)""")

    def fused(s, d):
        by_name = ev.top_k(_parts(s, d), "q", ["p_size", "item"], 20).select("q", "item", "rank")
        return rounded(ev.fuse(_top(s, d, 20), by_name, "q", "item", 0.6), 10)

    reg.add("V11_rank_fusion", fused, f"""
        SELECT q, item, round(sum(s), 10) AS score FROM (
            SELECT q, item, 0.6 / (rank + 60) AS s FROM {TOP.format(k=20)}
            UNION ALL SELECT q, item, 0.4 / (rank + 60) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p_size, item) AS rank
            FROM {PARTS}) WHERE rank <= 20) GROUP BY ALL""")

    def recent(s, d):
        o = t.table(s, d, "orders").select(
            F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 500_000).alias("score"),
            F.to_date("o_orderdate").alias("updated"))
        top = ev.top_k(o, "q", [F.desc("score"), "item"], 6)
        return rounded(ev.recency_rerank(top, "q", "score", "updated", F.lit("2001-08-01").cast("date"), 2).select(
            "q", "item", "boosted", "rank"))

    reg.add("V12_recency_rerank", recent, """
        SELECT q, item, round(boosted, 6) AS boosted, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY boosted DESC, item) AS rank FROM (
                SELECT q, item, score * 0.8 + greatest(0, 1 - (DATE '2001-08-01' - updated) / 365) * 0.2 AS boosted FROM (
                    SELECT o_custkey AS q, o_orderkey AS item, o_totalprice / 500000 AS score, CAST(o_orderdate AS DATE) AS updated,
                           row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 500000 DESC, o_orderkey) AS rn FROM orders)
                WHERE rn <= 6)) WHERE rank <= 2""")
    flag = lambda s, d, f: t.table(s, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_extendedprice")
    reg.add("V13_psi", lambda s, d: rounded(ev.psi(flag(s, d, "A"), flag(s, d, "R"), "l_extendedprice")), """
        WITH e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lineitem WHERE l_returnflag = 'A'),
             b AS (SELECT l_returnflag AS f, len(list_filter(e, lambda x: x <= l_extendedprice)) AS bin FROM lineitem, e
                   WHERE l_returnflag IN ('A', 'R')),
             c AS (SELECT bin, greatest(count(*) FILTER (f = 'A') / (SELECT count(*) FROM b WHERE f = 'A'), 0.0001) AS r,
                          greatest(count(*) FILTER (f = 'R') / (SELECT count(*) FROM b WHERE f = 'R'), 0.0001) AS c FROM b GROUP BY bin)
        SELECT round(sum((c - r) * ln(c / r)), 6) AS psi, sum((c - r) * ln(c / r)) > 0.2 AS drift FROM c""")
    reg.add("V14_ks_two_sample", lambda s, d: rounded(ev.ks_two_sample(
        flag(s, d, "A"), flag(s, d, "R"), "l_extendedprice").select("statistic"), 8), """
        SELECT round(max(abs(ca / ta - cb / tb)), 8) AS statistic FROM (
            SELECT v, sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb
            FROM (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb
                  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1))""")
    reg.add("V14_ks_with_p_value", lambda s, d: ev.ks_two_sample(flag(s, d, "A"), flag(s, d, "R"), "l_extendedprice"))
    regr = """round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
        round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(avg(abs((y - p) / y)) FILTER (y <> 0) * 100, 6) AS mape"""
    reg.add("V15_metrics_by_segment", lambda s, d: rounded(ev.regression(_prices(s, d), "y", "p", ["l_returnflag"])),
            f"SELECT l_returnflag, {regr} FROM {PRICES} GROUP BY 1")
    reg.add("V16_variant_assignment", lambda s, d: t.table(s, d, "events").select(
        "event_id", ev.variant("checkout", F.col("user_id"), 0.5).alias("arm")), f"SELECT event_id, {ARM} AS arm FROM events")
    reg.add("V17_conversion_z_test", lambda s, d: rounded(ev.conversion_test(_arms(s, d), "arm", "bought").drop(
        "p_value", "significant"), 8), f"""
        SELECT round(c, 8) AS control_rate, round(t, 8) AS treatment_rate, round(t - c, 8) AS absolute_difference,
               round((t - c) / c, 8) AS relative_lift, round((t - c) / sqrt(p * (1 - p) * (1 / cn + 1 / tn)), 8) AS z,
               round((t - c) - {stats.z_critical(0.05)!r} * sqrt(c * (1 - c) / cn + t * (1 - t) / tn), 8) AS ci_low,
               round((t - c) + {stats.z_critical(0.05)!r} * sqrt(c * (1 - c) / cn + t * (1 - t) / tn), 8) AS ci_high
        FROM (SELECT *, cc / cn AS c, tc / tn AS t, (cc + tc) / (cn + tn) AS p FROM (
            SELECT count(*) FILTER (arm = 'control') AS cn, count(*) FILTER (arm = 'treatment') AS tn,
                   count(*) FILTER (arm = 'control' AND event_type = 'purchase') AS cc,
                   count(*) FILTER (arm = 'treatment' AND event_type = 'purchase') AS tc FROM (SELECT *, {ARM} AS arm FROM events)))""")
    reg.add("V17_welch_t_test", lambda s, d: rounded(ev.welch_test(_arms(s, d), "arm", "value").select(
        "control_mean", "treatment_mean", "absolute_difference", "relative_lift", "t_stat", "df")), f"""
        SELECT round(cm, 6) AS control_mean, round(tm, 6) AS treatment_mean, round(tm - cm, 6) AS absolute_difference,
               round((tm - cm) / cm, 6) AS relative_lift, round((tm - cm) / sqrt(a + b), 6) AS t_stat,
               round(pow(a + b, 2) / (pow(a, 2) / (cn - 1) + pow(b, 2) / (tn - 1)), 6) AS df
        FROM (SELECT *, cv / cn AS a, tv / tn AS b FROM (
            SELECT avg(value) FILTER (arm = 'control') AS cm, avg(value) FILTER (arm = 'treatment') AS tm,
                   var_samp(value) FILTER (arm = 'control') AS cv, var_samp(value) FILTER (arm = 'treatment') AS tv,
                   count(*) FILTER (arm = 'control') AS cn, count(*) FILTER (arm = 'treatment') AS tn
            FROM (SELECT *, {ARM} AS arm FROM events)))""")

    def sizes(s, d):
        base = t.table(s, d, "events").groupBy("user_id").agg(
            F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate")).filter("rate > 0")
        return ev.sample_size(base.withColumn("lift", F.lit(0.1)), "rate", "lift").select("user_id", "sample_size")

    za, zb = stats.z_critical(0.05), stats.NORMAL.inv_cdf(0.8)
    reg.add("V18_sample_size", sizes, f"""
        SELECT user_id, CAST(ceil(pow({za!r} * sqrt(2 * bar * (1 - bar)) + {zb!r} * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2)
               / pow(p2 - p1, 2)) AS BIGINT) AS sample_size
        FROM (SELECT *, (p1 + p2) / 2 AS bar FROM (SELECT *, p1 * (1 + CAST(0.1 AS DOUBLE)) AS p2 FROM (
            SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS p1 FROM events GROUP BY 1) WHERE p1 > 0))""")
    near = f"""(SELECT a.id, b.id AS neighbour, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.id
        ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rank, list_cosine_similarity(a.v, b.v) AS score
        FROM {VECTORS} a JOIN {VECTORS} b ON a.id <> b.id)"""
    reg.add("V19_nearest_neighbours", lambda s, d: pr.neighbours(_vectors(s, d), 5).select(
        "id", "neighbour", "rank", F.round("score", 6).alias("score")),
        f"SELECT id, neighbour, rank, round(score, 6) AS score FROM {near} WHERE rank <= 5")

    def mined(s, d):
        """Positives: the neighbours with the query's own label."""
        e = t.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
        near_rows = cut(pr.neighbours(_vectors(s, d), 11), "near-rows")
        same = near_rows.join(e, "id").join(e.select(F.col("id").alias("neighbour"), F.col("label").alias("l2")), "neighbour").filter(
            "label = l2").select("id", "neighbour")
        return pr.hard_negatives(_vectors(s, d), same, near=near_rows).select("id", "neighbour", "nth")

    reg.add("V19_hard_negatives", mined, f"""
        SELECT id, neighbour, nth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS nth FROM {near}
        WHERE rank <= 11 AND la <> lb) WHERE nth <= 3""")
    reg.add("V20_text_clean_up", lambda s, d: t.table(s, d, "documents").select(
        "doc_id", pr.clean_text(F.col("text"), "passage: ").alias("clean")), r"""
        SELECT doc_id, 'passage: ' || trim(regexp_replace(regexp_replace(text, '[\s\p{Z}\x{85}\v]+', ' ', 'g'),
               '[^\p{L}\p{N}_ .,!?\-:;()]', '', 'g')) AS clean FROM documents""")
    reg.add("V21_classification", lambda s, d: rounded(ev.classification(_labelled(s, d), "quality", "guess")), f"""
        SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
               round(sum(r * support) / sum(support), 6) AS recall,
               round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1
        FROM (SELECT support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
                     CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM (
            SELECT c, count(*) FILTER (quality = c) AS support, count(*) FILTER (guess = c) AS predicted,
                   count(*) FILTER (quality = c AND guess = c) AS tp
            FROM {LABELLED}, (SELECT unnest([0, 1]) AS c) GROUP BY c))""")
    reg.add("V21_classification_by_language", lambda s, d: rounded(ev.classification(
        _labelled(s, d), "quality", "guess", ["lang"]).select("lang", "accuracy", "recall")), f"""
        SELECT lang, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 6) AS recall FROM {LABELLED} GROUP BY 1""")
    reg.add("V21_confusion_matrix", lambda s, d: ev.confusion_matrix(_labelled(s, d), "quality", "guess"),
            f"SELECT quality AS truth, guess AS predicted, count(*) AS n FROM {LABELLED} GROUP BY ALL")
    reg.add("V21_roc_auc", lambda s, d: rounded(ev.auc(_labelled(s, d), "quality", "n_chars"), 8), f"""
        SELECT round(sum(neg * (cp - pos + pos / 2)) / (max(tp) * max(tn)), 8) AS roc_auc,
               round(sum(pos / tp * cp / (cp + cn)), 8) AS average_precision FROM (
            SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM (
                SELECT n_chars, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM {LABELLED} GROUP BY 1)
            WINDOW w AS (ORDER BY n_chars DESC))""")
    reg.add("V22_regression", lambda s, d: rounded(ev.regression(_prices(s, d), "y", "p")), f"SELECT {regr} FROM {PRICES}")
    reg.add("V23_mcnemar", lambda s, d: rounded(ev.mcnemar(_labelled(s, d), "quality", "guess", "other").drop("p_value")), f"""
        SELECT count(*) FILTER (quality = guess AND quality <> other) AS only_a,
               count(*) FILTER (quality <> guess AND quality = other) AS only_b,
               round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0 END), 6) AS accuracy_a,
               round(avg(CASE WHEN quality = other THEN 1.0 ELSE 0 END), 6) AS accuracy_b,
               round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0 END) - avg(CASE WHEN quality = other THEN 1.0 ELSE 0 END), 6)
               AS difference FROM {LABELLED}""")
    reg.add("V23_paired_t", lambda s, d: rounded(ev.paired_t(_prices(s, d), "y", "p").select(
        "mean_a", "mean_b", "difference", "t_stat")), f"""
        SELECT round(avg(y), 6) AS mean_a, round(avg(p), 6) AS mean_b, round(avg(y - p), 6) AS difference,
               round(avg(y - p) / (stddev_samp(y - p) / sqrt(count(*))), 6) AS t_stat FROM {PRICES}""")
    reg.add("V23_bootstrap_interval", lambda s, d: ev.bootstrap_ci(t.table(s, d, "events"), "value", 100))
    reg.add("V24_date_features", lambda s, d: ev.date_features(t.table(s, d, "events").select("event_id", "ts"), "ts"), """
        SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dayofweek,
               hour(ts) AS ts_hour, CASE WHEN isodow(ts) > 5 THEN 1 ELSE 0 END AS ts_is_weekend, quarter(ts) AS ts_quarter FROM events""")
    reg.add("V25_target_encoding", lambda s, d: rounded(ev.target_encoding(
        t.table(s, d, "part"), "p_brand", "p_size", 10.0)), """
        SELECT p_brand, round((count(*) * avg(p_size) + 10 * (SELECT avg(p_size) FROM part)) / (count(*) + 10), 6) AS encoding
        FROM part GROUP BY 1""")
