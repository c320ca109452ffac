"""Retrieval, drift, experiment and model metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions import stats
from tallyforge.operators.splitwindow import OrderedParts

# Fusion constant, drift floor and alarm level.
RRF_K = 60
PSI_FLOOR, PSI_ALARM, PSI_BINS = 0.0001, 0.2, 10


# --------------------------------------------------------------------- retrieval

def top_k(ranked: DataFrame, query: str, order: Sequence, k: int) -> DataFrame:
    """First ``k`` rows per query with their rank; cut down before the shuffle."""
    w = Window.partitionBy(query).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieval_metrics(top: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """V9. ``top`` (query, item, rank <= k), ``relevant`` (query, item): metrics per query."""
    total = relevant.groupBy(query).agg(F.count("*").alias("n_relevant"))
    hits = top.join(relevant.withColumn("hit", F.lit(1)), [query, item], "left").groupBy(query).agg(
        F.count("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    found, n = F.col("found"), F.coalesce("n_relevant", F.lit(0))
    return hits.join(total, query, "left").select(
        query, (found / F.lit(k)).alias("precision_at_k"),
        F.when(n > 0, found / n).otherwise(0.0).alias("recall_at_k"),
        F.when(found > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def _dcg(rank: Column, rel: Column) -> Column:
    return F.sum(rel / F.log2(rank + 1))


def ndcg(top: DataFrame, graded: DataFrame, query: str, item: str, rel: str, k: int) -> DataFrame:
    """V10. Ideal order: the ``k`` highest grades of the query."""
    got = top.join(graded, [query, item], "left").groupBy(query).agg(
        _dcg(F.col("rank"), F.coalesce(rel, F.lit(0))).alias("dcg"))
    ideal = top_k(graded, query, [F.desc(rel), item], k).groupBy(query).agg(
        _dcg(F.col("rank"), F.col(rel)).alias("ideal"))
    return got.join(ideal, query, "left").select(
        query, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def fuse(
    first: DataFrame, second: DataFrame, query: str, item: str, weight: float = 0.5, k: int = RRF_K
) -> DataFrame:
    """V11. Two ranked lists to one reciprocal-rank score per item."""
    score = lambda df, w: df.select(query, item, (F.lit(w) * (F.lit(1.0) / (F.col("rank") + k))).alias("score"))
    return score(first, weight).unionByName(score(second, 1 - weight)).groupBy(query, item).agg(
        F.sum("score").alias("score"))


def recency_rerank(
    top: DataFrame, query: str, score: str, updated: str, as_of: Column, k: int, weight: float = 0.2
) -> DataFrame:
    """V12. Blend the score with a one-year linear decay; ``top`` holds 3 * k rows per query."""
    age = F.datediff(as_of, F.col(updated))
    boosted = F.col(score) * (1 - weight) + F.greatest(F.lit(0.0), 1 - age / 365) * weight
    return top_k(top.drop("rank").withColumn("boosted", boosted), query, [F.desc("boosted"), F.asc("item")], k)


# --------------------------------------------------------------------- drift

def exact_quantiles(values: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """(p, value) with linear interpolation, by counting up distinct values.

    Equal values are combined first; the running count is range-partitioned, so
    no task sees all values.
    """
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count("*").alias("n")).withColumn("g", F.lit(0))
    ordered = OrderedParts(counts, ["g"], ["v"]).running_sum("upto", F.col("n")).result()
    total = ordered.agg(F.max("upto").alias("total"))
    # Position of each probability: between the ranks lo and lo + 1 (from 0).
    at = F.array(*[F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos"))
                   for p in probabilities])
    start = F.col("upto") - F.col("n")
    low, high = F.floor("w.pos"), F.ceil("w.pos")
    covered = ordered.join(total, F.lit(True)).withColumn("start", start).withColumn(
        "w", F.explode(F.filter(at, lambda w: (F.ceil(w["pos"]) >= F.col("start")) & (F.floor(w["pos"]) < F.col("upto")))))
    return covered.groupBy(F.col("w.p").alias("p"), F.col("w.pos").alias("pos")).agg(
        F.max(F.when((low >= F.col("start")) & (low < F.col("upto")), F.col("v"))).alias("a"),
        F.max(F.when((high >= F.col("start")) & (high < F.col("upto")), F.col("v"))).alias("b"),
    ).select("p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("value"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = PSI_BINS) -> DataFrame:
    """V13. Population stability over the deciles of the reference."""
    edges = exact_quantiles(reference, column, [i / bins for i in range(1, bins)]).agg(
        F.sort_array(F.collect_list("value")).alias("edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
        binned = counted.join(edges, F.lit(True)).withColumn(
            "bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
        per_bin = binned.groupBy("bin").agg(F.sum("n").alias("n"))
        total = per_bin.agg(F.sum("n").alias("total"))
        return per_bin.join(total, F.lit(True)).select("bin", (F.col("n") / F.col("total")).alias(name))

    both = shares(reference, "ref").join(shares(current, "cur"), "bin", "full")
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(PSI_FLOOR))
    r, c = floor("ref"), floor("cur")
    return both.agg(F.sum((c - r) * F.ln(c / r)).alias("psi")).withColumn("drift", F.col("psi") > PSI_ALARM)


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """V14. Largest distance of the two distribution functions, and its asymptotic p-value."""
    tag = lambda df, x, y: df.filter(F.col(column).isNotNull()).select(
        F.col(column).alias("v"), F.lit(x).cast("long").alias("na"), F.lit(y).cast("long").alias("nb"))
    counts = tag(a, 1, 0).unionByName(tag(b, 0, 1)).groupBy("v").agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb")).withColumn("g", F.lit(0))
    cum = OrderedParts(counts, ["g"], ["v"]).running_sum("ca", F.col("na")).running_sum("cb", F.col("nb")).result()
    total = cum.agg(F.max("ca").alias("ta"), F.max("cb").alias("tb"))
    return cum.join(total, F.lit(True)).groupBy("ta", "tb").agg(
        F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("statistic")
    ).select("statistic", stats.on_result(stats.ks_p, F.col("statistic"), F.col("ta"), F.col("tb")).alias("p_value"))


# --------------------------------------------------------------------- experiments

def variant(experiment: str, user: Column, split: float) -> Column:
    """V16. md5 of 'experiment:user' as a fraction; the top 52 of its 128 bits are used."""
    digest = F.md5(F.concat(F.lit(f"{experiment}:"), user.cast("string")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return F.when(share < split, "treatment").otherwise("control")


def conversion_test(rows: DataFrame, arm: str, converted: str, significance: float = 0.05) -> DataFrame:
    """V17. Two-proportion z-test of treatment against control."""
    is_t = F.col(arm) == "treatment"
    n = rows.agg(
        F.count_if(~is_t).alias("cn"), F.count_if(is_t).alias("tn"),
        F.count_if(~is_t & F.col(converted)).alias("cc"), F.count_if(is_t & F.col(converted)).alias("tc"))
    n = n.withColumns({"c": F.col("cc") / F.col("cn"), "t": F.col("tc") / F.col("tn"),
                       "pool": (F.col("cc") + F.col("tc")) / (F.col("cn") + F.col("tn"))})
    c, t, pool = F.col("c"), F.col("t"), F.col("pool")
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("cn") + 1 / F.col("tn")))
    spread = F.sqrt(c * (1 - c) / F.col("cn") + t * (1 - t) / F.col("tn"))
    z = stats.z_critical(significance)
    out = n.select(
        c.alias("control_rate"), t.alias("treatment_rate"), (t - c).alias("absolute_difference"),
        F.when(c > 0, (t - c) / c).otherwise(0.0).alias("relative_lift"), ((t - c) / se).alias("z"),
        ((t - c) - z * spread).alias("ci_low"), ((t - c) + z * spread).alias("ci_high"))
    return out.withColumn("p_value", stats.on_result(stats.normal_two_sided, F.col("z"))).withColumn(
        "significant", F.col("p_value") < significance)


def welch_test(rows: DataFrame, arm: str, value: str, significance: float = 0.05) -> DataFrame:
    """V17. Welch t-test; the interval uses population variances and the smaller sample's degrees."""
    side = lambda name, p: rows.filter(F.col(arm) == name).agg(
        F.avg(value).alias(f"{p}m"), F.var_samp(value).alias(f"{p}v"), F.var_pop(value).alias(f"{p}pv"),
        F.count(value).alias(f"{p}n"))
    m = side("control", "c").join(side("treatment", "t"), F.lit(True))
    a, b = F.col("cv") / F.col("cn"), F.col("tv") / F.col("tn")
    m = m.withColumns({
        "t_stat": (F.col("tm") - F.col("cm")) / F.sqrt(a + b),
        "df": F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("cn") - 1) + F.pow(b, 2) / (F.col("tn") - 1)),
        "se": F.sqrt(F.col("cpv") / F.col("cn") + F.col("tpv") / F.col("tn")),
        "t_crit": stats.on_result(lambda n: stats.t_critical(significance, n), (F.least("cn", "tn") - 1).cast("double")),
    })
    diff = F.col("tm") - F.col("cm")
    return m.select(
        F.col("cm").alias("control_mean"), F.col("tm").alias("treatment_mean"), diff.alias("absolute_difference"),
        F.when(F.col("cm") > 0, diff / F.col("cm")).otherwise(0.0).alias("relative_lift"), "t_stat", "df",
        stats.on_result(stats.t_two_sided, F.col("t_stat"), F.col("df")).alias("p_value"),
        (diff - F.col("t_crit") * F.col("se")).alias("ci_low"), (diff + F.col("t_crit") * F.col("se")).alias("ci_high"))


def sample_size(rows: DataFrame, baseline: str, effect: str, significance: float = 0.05, power: float = 0.8) -> DataFrame:
    """V18. Needed users per arm for each (baseline, effect) row."""
    za, zb = stats.z_critical(significance), stats.NORMAL.inv_cdf(power)
    p1, p2 = F.col(baseline), F.col(baseline) * (1 + F.col(effect))
    bar = (p1 + p2) / 2
    root = za * F.sqrt(2 * bar * (1 - bar)) + zb * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return rows.withColumn("sample_size", F.ceil(F.pow(root, 2) / F.pow(p2 - p1, 2)))


# --------------------------------------------------------------------- model metrics

def classification(rows: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """V21 (and V15 with segment ``keys``): accuracy and weighted precision, recall and F1.

    Everything follows from the confusion counts, a table as small as the label set squared.
    """
    cells = rows.groupBy(*keys, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    per_label = cells.select(*keys, F.col("y").alias("label"), "n", (F.col("y") == F.col("p")).alias("ok"), F.lit(True).alias("is_true")) \
        .unionByName(cells.select(*keys, F.col("p").alias("label"), "n", (F.col("y") == F.col("p")).alias("ok"), F.lit(False).alias("is_true"))) \
        .groupBy(*keys, "label").agg(
            F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("is_true") & F.col("ok"), F.col("n")).otherwise(0)).alias("tp"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = zero(F.col("tp"), F.col("predicted")), zero(F.col("tp"), F.col("support"))
    scored = per_label.withColumns({"p": p, "r": r}).withColumn(
        "f", zero(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    weigh = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return scored.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), weigh("p").alias("precision"), weigh("r").alias("recall"),
        weigh("f").alias("f1"))


def confusion_matrix(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """V21. ROC-AUC (ties count half) and average precision from counts per distinct score."""
    counts = rows.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg")
    ).withColumns({"g": F.lit(0), "down": -F.col("s")})
    cum = OrderedParts(counts, ["g"], ["down"]).running_sum("cp", F.col("pos")).running_sum("cn", F.col("neg")).result()
    total = cum.agg(F.max("cp").alias("tp"), F.max("cn").alias("tn"))
    above = F.col("cp") - F.col("pos")  # positives with a higher score
    return cum.join(total, F.lit(True)).groupBy("tp", "tn").agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("u"),
        F.sum(F.col("pos") / F.col("tp") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("average_precision"),
    ).select((F.col("u") / (F.col("tp") * F.col("tn"))).alias("roc_auc"), "average_precision")


def regression(rows: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared, root, absolute error, R2 and MAPE without the zero truths."""
    y, p = F.col(truth), F.col(pred)
    e = y - p
    m = rows.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("mape"))
    return m.select(
        *keys, "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.col("var")).alias("r2"), "mape")


def mcnemar(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """V23."""
    ok_a, ok_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    n = rows.agg(
        F.count_if(ok_a & ~ok_b).alias("only_a"), F.count_if(~ok_a & ok_b).alias("only_b"),
        F.avg(ok_a.cast("double")).alias("accuracy_a"), F.avg(ok_b.cast("double")).alias("accuracy_b"))
    return n.withColumns({
        "difference": F.col("accuracy_a") - F.col("accuracy_b"),
        "p_value": stats.on_result(stats.mcnemar_p, F.col("only_a"), F.col("only_b"))})


def paired_t(rows: DataFrame, a: str, b: str, significance: float = 0.05) -> DataFrame:
    """V23."""
    d = F.col(a) - F.col(b)
    m = rows.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("difference"),
                 F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    se = F.col("sd") / F.sqrt("n")
    degrees = (F.col("n") - 1).cast("double")
    m = m.withColumns({
        "t_stat": F.col("difference") / se,
        "margin": stats.on_result(lambda n: stats.t_critical(significance, n), degrees) * se})
    return m.select(
        "mean_a", "mean_b", "difference", "t_stat",
        stats.on_result(stats.t_two_sided, F.col("t_stat"), degrees).alias("p_value"),
        (F.col("difference") - F.col("margin")).alias("ci_low"), (F.col("difference") + F.col("margin")).alias("ci_high"))


def bootstrap_ci(rows: DataFrame, value: str, replicates: int = 200, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """V23. Interval of the mean by Poisson weights: every row draws one weight per
    replicate, so replicates are sums in one pass and rows are never copied."""
    drawn = rows.select(F.col(value).alias("v"), F.array(*[F.rand(seed * 10_007 + i) for i in range(replicates)]).alias("us"))
    edges, p, total = [], 0.36787944117144233, 0.0  # Poisson(1) masses
    for k in range(12):
        total += p
        edges.append(total)
        p /= k + 1
    w = lambda u: sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    per = drawn.select("v", F.posexplode(F.transform("us", w)).alias("replicate", "w")).groupBy("replicate").agg(
        (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
    return per.agg(
        F.expr(f"percentile(mean, {alpha / 2})").alias("ci_low"),
        F.expr(f"percentile(mean, {1 - alpha / 2})").alias("ci_high"), F.count("*").alias("replicates"))


# --------------------------------------------------------------------- features

def date_features(df: DataFrame, column: str) -> DataFrame:
    """V24. Monday is 0."""
    c = F.col(column)
    weekday = F.weekday(c)
    return df.withColumns({
        f"{column}_year": F.year(c), f"{column}_month": F.month(c), f"{column}_day": F.dayofmonth(c),
        f"{column}_dayofweek": weekday, f"{column}_hour": F.hour(c),
        f"{column}_is_weekend": weekday.isin(5, 6).cast("int"), f"{column}_quarter": F.quarter(c)}).drop(column)


def target_encoding(df: DataFrame, column: str, target: str, smoothing: float = 1.0) -> DataFrame:
    """V25. Smoothed mean of the target per category: (category, encoding)."""
    total = df.agg(F.avg(target).alias("m"))
    per = df.groupBy(column).agg(F.avg(target).alias("mean"), F.count(target).alias("n"))
    return per.join(total, F.lit(True)).select(
        column, ((F.col("n") * F.col("mean") + smoothing * F.col("m")) / (F.col("n") + smoothing)).alias("encoding"))
