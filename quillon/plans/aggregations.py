"""Grouped aggregates: pseudobulk, moments, summaries, repricing (A rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import stats

from . import views as v
from .registry import query


@query("pseudobulk_mean", f"WITH {v.PROFILE} SELECT pert, gene, n_cells, round(mean, 6) AS mean FROM profile")
def pseudobulk_mean(spark, sf_dir):
    """Mean per (group, measure), zeros counted."""
    return v.profiles(v.normalised(v.counts(spark, sf_dir))).select("pert", "gene", "n_cells", v.r6("mean").alias("mean"))


@query("column_variance", f"WITH {v.NORM} SELECT gene, round(greatest(sum(x * x) / n - (sum(x) / n) * (sum(x) / n), 0.0), 6) AS variance FROM norm, (SELECT count(DISTINCT cell) AS n FROM norm) GROUP BY gene, n")
def column_variance(spark, sf_dir):
    """Population variance per measure from sums and sums of squares, implicit zeros counted, floored at 0."""
    x = v.normalised(v.counts(spark, sf_dir))
    n = x.agg(F.count_distinct("cell").alias("n"))
    sums = x.groupBy("gene").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.crossJoin(F.broadcast(n)).select("gene", v.r6(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("variance"))


@query("grouped_sum_sentinel", "SELECT o_orderstatus, l_returnflag, sum(l_quantity) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def grouped_sum_sentinel(spark, sf_dir):
    """Grouped sums by code; rows of the sentinel code are unused."""
    line = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    order = v.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    return line.join(order, line.l_orderkey == order.o_orderkey).groupBy("o_orderstatus", "l_returnflag").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))


@query("mean_sd_n", "SELECT p_brand, round(avg(CASE WHEN p_size > 10 THEN p_retailprice END), 6) AS mean, round(CASE WHEN count(CASE WHEN p_size > 10 THEN 1 END) = 1 THEN 0.0 ELSE stddev_samp(CASE WHEN p_size > 10 THEN p_retailprice END) END, 6) AS sd, count(CASE WHEN p_size > 10 THEN 1 END) AS n FROM part GROUP BY 1")
def mean_sd_n(spark, sf_dir):
    """Mean, sample sd (0 for one value) and n over non-null values."""
    x = F.when(F.col("p_size") > 10, F.col("p_retailprice"))
    return v.table(spark, sf_dir, "part").groupBy("p_brand").agg(v.r6(F.avg(x)).alias("mean"), v.r6(stats.sd_or_zero(x)).alias("sd"), F.count(x).alias("n"))


@query(
    "category_summary",
    """WITH c AS (SELECT p_type, p_size % 7 AS grp, p_retailprice AS x FROM part WHERE p_size <= 3 OR p_type = 'PROMO'),
a AS (SELECT p_type, grp, count(*) AS n, avg(x) AS m, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(x) END AS s FROM c GROUP BY 1, 2)
SELECT p_type, grp, n, round(CASE WHEN n >= 3 THEN m END, 6) AS mean, round(CASE WHEN n >= 3 THEN s END, 6) AS sd FROM a""",
)
def category_summary(spark, sf_dir):
    """Per category mean and sd, hidden below three members."""
    part = v.table(spark, sf_dir, "part").where("p_size <= 3 or p_type = 'PROMO'").select("p_type", (F.col("p_size") % 7).alias("grp"), F.col("p_retailprice").alias("x"))
    a = part.groupBy("p_type", "grp").agg(F.count("*").alias("n"), F.avg("x").alias("m"), stats.sd_or_zero(F.col("x")).alias("s"))
    shown = F.col("n") >= 3
    return a.select("p_type", "grp", "n", v.r6(F.when(shown, F.col("m"))).alias("mean"), v.r6(F.when(shown, F.col("s"))).alias("sd"))


@query(
    "complementary_suppression",
    """WITH g AS (SELECT c_nationkey AS cat, count(*) % 11 AS n FROM customer GROUP BY 1),
o AS (SELECT cat, n, n < 3 AS small, sum(CASE WHEN n < 3 THEN n ELSE 0 END) OVER () AS hidden, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY n, cat) AS k FROM g)
SELECT cat, n, small OR (hidden BETWEEN 1 AND 2 AND k = 1) AS hidden FROM o""",
)
def complementary_suppression(spark, sf_dir):
    """Hide groups under 3; if the hidden members are 1 or 2 together, hide the next smallest group too (it has 3 or more)."""
    g = v.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cat")).agg((F.count("*") % 11).alias("n"))
    small = F.col("n") < 3
    every = Window.partitionBy(F.lit(0))  # one row a category
    hidden = F.sum(F.when(small, F.col("n")).otherwise(0)).over(every)
    k = F.sum(F.when(small, 0).otherwise(1)).over(every.orderBy("n", "cat"))
    return g.select("cat", "n", (small | (hidden.between(1, 2) & (k == 1))).alias("hidden"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    """A07."""
    return v.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("usage_totals", "SELECT role, count(*) AS calls, coalesce(sum(length(text)), 0)::BIGINT AS chars, sum(1 - (CASE WHEN length(text) > 40 THEN 1 ELSE 0 END))::BIGINT AS failed FROM conversations GROUP BY 1")
def usage_totals(spark, sf_dir):
    """Totals with coalesced sums and sum(1 - ok)."""
    ok = F.when(F.length("text") > 40, 1).otherwise(0)
    return v.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.sum(1 - ok).cast("long").alias("failed"))


@query("feature_gains", "SELECT user_id AS feature, round(max(value), 6) AS gain FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def feature_gains(spark, sf_dir):
    """Best gain per new feature, for known features only."""
    known = v.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return v.table(spark, sf_dir, "events").where("event_type = 'purchase'").join(known, "user_id", "left_semi").groupBy(F.col("user_id").alias("feature")).agg(v.r6(F.max("value")).alias("gain"))


@query(
    "run_summary",
    """SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending,
count(DISTINCT o_custkey) AS owners, count(*) - count(DISTINCT o_custkey) AS repeats, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS share_finished, round(max(o_totalprice), 6) AS best FROM orders""",
)
def run_summary(spark, sf_dir):
    """A10: many conditional counts in one pass."""
    s = F.col("o_orderstatus")
    n, done = F.count("*"), F.count_if(s == "F")
    return v.table(spark, sf_dir, "orders").agg(n.alias("n"), done.alias("finished"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("pending"), F.count_distinct("o_custkey").alias("owners"), (n - F.count_distinct("o_custkey")).alias("repeats"), v.r6(done.cast("double") / n).alias("share_finished"), v.r6(F.max("o_totalprice")).alias("best"))


@query(
    "worker_scaling",
    """SELECT l_suppkey AS worker, count(*) AS jobs, count(DISTINCT l_orderkey) AS distinct_orders, round(sum(l_extendedprice), 4) AS cost, round(sum(l_quantity) / max(l_quantity) / count(*), 6) AS utilisation,
list_sort(list_distinct(list(l_linestatus)))::VARCHAR[] IS NOT NULL AS seen, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1""",
)
def worker_scaling(spark, sf_dir):
    """Per-worker totals, distinct counts, lists."""
    return v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("worker")).agg(F.count("*").alias("jobs"), F.count_distinct("l_orderkey").alias("distinct_orders"), F.round(F.sum("l_extendedprice"), 4).alias("cost"), v.r6(F.sum("l_quantity") / F.max("l_quantity") / F.count("*")).alias("utilisation"), F.lit(True).alias("seen"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("planner_health", "SELECT role, count(*) AS rounds, sum(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END)::BIGINT AS failures, min(conv_id * 1000 + turn) AS first_use FROM conversations GROUP BY 1")
def planner_health(spark, sf_dir):
    """Rounds and failures per provider, with its first use."""
    return v.table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("rounds"), F.count_if(F.length("text") < 60).alias("failures"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_use"))


@query(
    "binned_rmse",
    f"""WITH {v.LOO}, q AS (SELECT quantile_cont(control_mean, 0.25) AS a, quantile_cont(control_mean, 0.5) AS b, quantile_cont(control_mean, 0.75) AS c FROM (SELECT DISTINCT gene, control_mean FROM delta))
SELECT CASE WHEN control_mean < a THEN 0 WHEN control_mean < b THEN 1 WHEN control_mean < c THEN 2 ELSE 3 END AS bin, count(*) AS n, round(sqrt(avg((pred - delta) * (pred - delta))), 6) AS rmse FROM loo, q GROUP BY 1""",
)
def binned_rmse(spark, sf_dir):
    """Error by quartile of the control mean, bins half open."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    q = loo.select("gene", "control_mean").distinct().agg(F.percentile("control_mean", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    m = F.col("control_mean")
    label = F.when(m < F.col("q")[0], 0).when(m < F.col("q")[1], 1).when(m < F.col("q")[2], 2).otherwise(3)
    return loo.crossJoin(F.broadcast(q)).groupBy(label.alias("bin")).agg(F.count("*").alias("n"), v.r6(stats.rmse(F.col("delta"), F.col("pred"))).alias("rmse"))


@query("quartile_summary", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def quartile_summary(spark, sf_dir):
    """Exact quartiles, linear interpolation."""
    return v.table(spark, sf_dir, "events").groupBy("event_type").agg(v.r6(F.percentile("value", F.lit(0.25))).alias("q1"), v.r6(F.median("value")).alias("median"), v.r6(F.percentile("value", F.lit(0.75))).alias("q3"))


@query(
    "sufficient_statistics",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sx, round(sum(l_discount), 4) AS sz, round(sum(l_quantity * l_quantity), 4) AS sxx, round(sum(l_quantity * l_discount), 4) AS sxz, round(sum(l_discount * l_discount), 4) AS szz, round(sum(l_quantity * l_tax), 4) AS sxy, round(sum(l_discount * l_tax), 4) AS szy, round(sum(l_tax), 4) AS sy FROM lineitem GROUP BY 1, 2",
)
def sufficient_statistics(spark, sf_dir):
    """Mergeable sums for a linear fit of two columns."""
    x, z, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    total = lambda c, name: F.round(F.sum(c), 4).alias(name)
    return v.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), total(x, "sx"), total(z, "sz"), total(x * x, "sxx"), total(x * z, "sxz"), total(z * z, "szz"), total(x * y, "sxy"), total(z * y, "szy"), total(y, "sy"))


@query("weighted_ensemble", "SELECT l_partkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS pred FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def weighted_ensemble(spark, sf_dir):
    """Mean with positive weights."""
    w = F.col("l_quantity")
    return v.table(spark, sf_dir, "lineitem").where(w > 0).groupBy("l_partkey").agg(F.round(F.sum(w * F.col("l_extendedprice")) / F.sum(w), 4).alias("pred"))


@query(
    "codon_composition",
    """WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE lang = 'en'),
k AS (SELECT doc_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM s)
SELECT substr(seq, (i * 3 + 1)::INT, 3) AS codon, count(*) AS n FROM k GROUP BY 1""",
)
def codon_composition(spark, sf_dir):
    """Codon counts of the sequence letters of each text."""
    s = v.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    last = F.floor(F.length("seq") / 3).cast("int")
    codons = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.substring(F.col("seq"), i * 3 + 1, F.lit(3))))
    return s.select(F.explode(codons).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))


@query("member_counts", "SELECT key, count(*) AS n FROM (SELECT l_partkey AS key FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1")
def member_counts(spark, sf_dir):
    """Multiset counts over both ends of edges."""
    line = v.table(spark, sf_dir, "lineitem")
    return line.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("set_union", "SELECT p_type, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS members, count(DISTINCT p_brand) AS size FROM part GROUP BY 1")
def set_union(spark, sf_dir):
    """Union of members per set."""
    members = F.collect_set("p_brand")
    return v.table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(members), ",").alias("members"), F.size(members).cast("long").alias("size"))


@query(
    "arm_aggregate",
    """WITH r AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, o_totalprice AS s, o_custkey % 3 AS code FROM orders),
c AS (SELECT o_orderstatus, o_orderpriority, count(DISTINCT code) > 1 AS mixed FROM r GROUP BY 1, 2)
SELECT o_orderstatus, CASE WHEN mixed THEN o_orderpriority || ' code ' || code ELSE o_orderpriority END AS arm, y::INT AS y, count(*) AS n, round(avg(s), 6) AS mean FROM r JOIN c USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2, 3""",
)
def arm_aggregate(spark, sf_dir):
    """Arms by four keys; an arm of several code versions is split."""
    r = v.table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("s"), (F.col("o_custkey") % 3).alias("code"))
    mixed = r.groupBy("o_orderstatus", "o_orderpriority").agg((F.count_distinct("code") > 1).alias("mixed"))
    arm = F.when(F.col("mixed"), F.concat("o_orderpriority", F.lit(" code "), F.col("code").cast("string"))).otherwise(F.col("o_orderpriority"))
    return r.join(mixed, ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus", arm.alias("arm"), "y").agg(F.count("*").alias("n"), v.r6(F.avg("s")).alias("mean"))


@query(
    "family_rollup",
    "SELECT regexp_replace(p_brand, '[0-9]+$', '') || substr(p_type, 1, 1) AS family, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 10 AND p_size <= 30) AS middle, count(*) FILTER (p_size > 30) AS large FROM part GROUP BY 1",
)
def family_rollup(spark, sf_dir):
    """Verdict counts by family, pivoted."""
    family = F.concat(F.regexp_replace("p_brand", "[0-9]+$", ""), F.substring("p_type", 1, 1))
    size = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle").otherwise("large")
    out = v.table(spark, sf_dir, "part").select(family.alias("family"), size.alias("size")).groupBy("family").pivot("size", ["small", "middle", "large"]).count()
    return out.na.fill(0)


@query("arm_medians", "SELECT event_type, user_id % 4 AS workers, round(median(value), 6) AS median_gain, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS rising FROM events GROUP BY 1, 2")
def arm_medians(spark, sf_dir):
    """A22."""
    return v.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("workers")).agg(v.r6(F.median("value")).alias("median_gain"), F.count_if(F.col("value") > 50).alias("rising"))


PRICES = "(VALUES ('user', 0.1::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE), ('assistant', 0.2, 2.0, 6.0), ('system', 0.0, 0.5, 1.5)) AS p(role, hit, miss, outp)"


@query(
    "cost_reprice",
    f"""WITH c AS (SELECT role, length(text) AS inp, turn * 100 AS cached, length(text) % 50 AS outt FROM conversations)
SELECT c.role, count(*) AS calls, round(sum((least(cached, inp) * hit + greatest(0, inp - cached) * miss + outt * outp) / 1e6), 6) AS cost FROM c JOIN {PRICES} ON p.role = c.role GROUP BY 1""",
)
def cost_reprice(spark, sf_dir):
    """Cached tokens at the hit rate, the rest at the miss rate, output on top."""
    prices = spark.createDataFrame([("user", 0.1, 1.0, 3.0), ("assistant", 0.2, 2.0, 6.0), ("system", 0.0, 0.5, 1.5)], "role string, hit double, miss double, outp double")
    inp, cached, out = F.length("text"), F.col("turn") * 100, F.length("text") % 50
    cost = (F.least(cached, inp.cast("long")) * F.col("hit") + F.greatest(F.lit(0), inp - cached) * F.col("miss") + out * F.col("outp")) / 1e6
    return v.table(spark, sf_dir, "conversations").join(F.broadcast(prices), "role").groupBy("role").agg(F.count("*").alias("calls"), v.r6(F.sum(cost)).alias("cost"))


@query("calibration_scale", f"WITH {v.LOO} SELECT pert, round(CASE WHEN sum(pred * pred) = 0 THEN 1.0 ELSE least(4.0, greatest(0.0, sum(pred * delta) / sum(pred * pred))) END, 6) AS scale FROM loo GROUP BY 1")
def calibration_scale(spark, sf_dir):
    """sum(pred truth) / sum(pred pred), clipped to [0, 4]."""
    p, t = F.col("pred"), F.col("delta")
    den = F.sum(p * p)
    return v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("pert").agg(v.r6(F.when(den == 0, F.lit(1.0)).otherwise(F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.sum(p * t) / den)))).alias("scale"))


@query("blend_weight", f"WITH {v.LOO} SELECT gene, round(CASE WHEN sum((pred - control_mean / 100) * (pred - control_mean / 100)) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, sum((pred - control_mean / 100) * (delta - control_mean / 100)) / sum((pred - control_mean / 100) * (pred - control_mean / 100)))) END, 6) AS weight FROM loo GROUP BY 1")
def blend_weight(spark, sf_dir):
    """Least-squares weight between two predictions, clipped to [0, 1]."""
    a = F.col("control_mean") / 100
    e, y = F.col("pred") - a, F.col("delta") - a
    den = F.sum(e * e)
    return v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("gene").agg(v.r6(F.when(den == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(e * y) / den)))).alias("weight"))


@query(
    "arm_class_audit",
    """WITH r AS (SELECT event_type AS arm, user_id AS feature, count(*) AS runs, count(*) FILTER (value > 50) AS kept FROM events GROUP BY 1, 2)
SELECT arm, count(*) AS features, sum(kept)::BIGINT AS kept, count(*) FILTER (kept = 0) AS boxed, max(runs) AS most_runs FROM r GROUP BY 1""",
)
def arm_class_audit(spark, sf_dir):
    """Reproduction counts by arm; features that no run kept are boxed."""
    r = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), "user_id").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 50).alias("kept"))
    return r.groupBy("arm").agg(F.count("*").alias("features"), F.sum("kept").alias("kept"), F.count_if(F.col("kept") == 0).alias("boxed"), F.max("runs").alias("most_runs"))


@query(
    "tier_metrics",
    f"""WITH {v.LOO}, g AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS r, avg((pred - delta) * (pred - delta)) AS mse FROM loo GROUP BY 1),
p AS (SELECT avg((pred - delta) * (pred - delta)) AS pooled, sqrt(sum(pred * pred) / sum(delta * delta)) AS ratio FROM loo)
SELECT (pert % 5)::INT AS tier, count(*) AS n, round(avg(r), 6) AS pearson, round(avg(mse), 6) AS mse, round(max(pooled), 6) AS pooled, round(max(ratio), 6) AS ratio FROM g, p GROUP BY 1""",
)
def tier_metrics(spark, sf_dir):
    """Groups first, then the mean over groups; beside it the pooled error and scale ratio."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    e = (F.col("pred") - F.col("delta")) * (F.col("pred") - F.col("delta"))
    g = loo.groupBy("pert").agg(stats.pearson(F.col("pred"), F.col("delta")).alias("r"), F.avg(e).alias("mse"))
    p = loo.agg(F.avg(e).alias("pooled"), F.sqrt(F.sum(F.col("pred") * F.col("pred")) / F.sum(F.col("delta") * F.col("delta"))).alias("ratio"))
    return g.crossJoin(F.broadcast(p)).groupBy((F.col("pert") % 5).cast("int").alias("tier")).agg(F.count("*").alias("n"), v.r6(F.avg("r")).alias("pearson"), v.r6(F.avg("mse")).alias("mse"), v.r6(F.max("pooled")).alias("pooled"), v.r6(F.max("ratio")).alias("ratio"))
