"""Metrics, statistics and inference (M rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators.numbering import value_ranks

from . import views as v
from .registry import query


def loo(spark, sf_dir) -> DataFrame:
    return v.loo_mean(v.delta_view(spark, sf_dir))


@query("pseudobulk_loo_pearson", f"WITH {v.LOO} SELECT pert, round({v.sql_pearson('pred', 'delta')}, 6) AS pearson FROM loo GROUP BY 1")
def pseudobulk_loo_pearson(spark, sf_dir):
    """M02 over A01 and F07: the flagship slice."""
    return loo(spark, sf_dir).groupBy("pert").agg(v.r6(stats.pearson(F.col("pred"), F.col("delta"))).alias("pearson"))


TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY pert ORDER BY round(abs(delta), 9) DESC, gene) AS rk FROM loo)"


def ranked(spark, sf_dir) -> DataFrame:
    return loo(spark, sf_dir).withColumn("rk", F.row_number().over(Window.partitionBy("pert").orderBy(F.round(F.abs("delta"), 9).desc(), "gene")))


@query(
    "evaluator",
    f"""WITH {v.LOO}, {TOP} SELECT pert, round({v.sql_pearson('pred', 'delta')}, 6) AS pearson_delta,
round({v.sql_pearson('CASE WHEN rk <= 10 THEN pred END', 'CASE WHEN rk <= 10 THEN delta END')}, 6) AS pearson_top,
round(avg(CASE WHEN rk <= 10 THEN CASE WHEN sign(pred) = sign(delta) THEN 1.0 ELSE 0.0 END END)::DOUBLE, 6) AS direction_top,
round(avg(CASE WHEN rk <= 10 THEN (pred - delta) * (pred - delta) END), 6) AS mse_top,
round(sqrt(avg((pred - delta) * (pred - delta))), 6) AS rmse, round(avg(abs(pred - delta)), 6) AS mae,
round({v.sql_pearson('pred + control_mean', 'mean')}, 6) AS pearson_expr,
round(1 - sum(CASE WHEN rk <= 10 THEN (pred - delta) * (pred - delta) END) / (var_pop(CASE WHEN rk <= 10 THEN delta END) * 10), 5) AS r2_top FROM ranked GROUP BY 1""",
)
def evaluator(spark, sf_dir):
    """All metrics of a group in one aggregation."""
    p, t, top = F.col("pred"), F.col("delta"), F.col("rk") <= 10
    err = (p - t) * (p - t)
    only = lambda c: F.when(top, c)
    return ranked(spark, sf_dir).groupBy("pert").agg(
        v.r6(stats.pearson(p, t)).alias("pearson_delta"),
        v.r6(stats.pearson(only(p), only(t))).alias("pearson_top"),
        v.r6(F.avg(only((F.signum(p) == F.signum(t)).cast("double")))).alias("direction_top"),
        v.r6(F.avg(only(err))).alias("mse_top"),
        v.r6(F.sqrt(F.avg(err))).alias("rmse"),
        v.r6(F.avg(F.abs(p - t))).alias("mae"),
        v.r6(stats.pearson(p + F.col("control_mean"), F.col("mean"))).alias("pearson_expr"),
        F.round(stats.r_squared(only(t), only(p)), 5).alias("r2_top"),
    )


@query("selection_score", f"WITH {v.LOO}, m AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS a, sqrt(avg((pred - delta) * (pred - delta))) AS b FROM loo GROUP BY 1) SELECT (pert % 5)::INT AS part, round(avg(0.5 * a + 0.5 * (1 - b)), 6) AS score FROM m GROUP BY 1")
def selection_score(spark, sf_dir):
    """M04."""
    m = loo(spark, sf_dir).groupBy("pert").agg(stats.pearson(F.col("pred"), F.col("delta")).alias("a"), stats.rmse(F.col("delta"), F.col("pred")).alias("b"))
    return m.groupBy((F.col("pert") % 5).cast("int").alias("part")).agg(v.r6(F.avg(0.5 * F.col("a") + 0.5 * (1 - F.col("b")))).alias("score"))


@query(
    "comparable_metrics",
    f"""WITH {v.LOO}, {TOP} SELECT pert, round(avg((pred - delta) * (pred - delta)), 6) AS mse, round({v.sql_pearson('pred', 'delta')}, 6) AS pcc, round(1 - sum((pred - delta) * (pred - delta)) / (var_pop(delta) * count(*)), 5) AS r2,
round(CASE WHEN count(*) FILTER (abs(delta) > 0.05) >= 2 THEN {v.sql_pearson('CASE WHEN abs(delta) > 0.05 THEN pred END', 'CASE WHEN abs(delta) > 0.05 THEN delta END')} END, 6) AS pcc_de FROM ranked GROUP BY 1""",
)
def comparable_metrics(spark, sf_dir):
    """Errors and correlations over all measures and over the changed ones (two at least)."""
    p, t = F.col("pred"), F.col("delta")
    de = F.abs(t) > 0.05
    return ranked(spark, sf_dir).groupBy("pert").agg(v.r6(F.avg((p - t) * (p - t))).alias("mse"), v.r6(stats.pearson(p, t)).alias("pcc"), F.round(stats.r_squared(t, p), 5).alias("r2"), v.r6(F.when(F.count_if(de) >= 2, stats.pearson(F.when(de, p), F.when(de, t)))).alias("pcc_de"))


BINARY = """b AS (SELECT d.lang AS grp, l.quality AS y, d.n_chars::DOUBLE AS s, d.n_chars > 1500 AS yhat FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1) / 2.0::DOUBLE AS mid FROM b),
u AS (SELECT grp, s, count(*) AS n, sum(y) AS pos FROM b GROUP BY 1, 2), c AS (SELECT grp, s, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY grp) AS p FROM u WINDOW w AS (PARTITION BY grp ORDER BY s DESC)),
ap AS (SELECT grp, sum(pos::DOUBLE / p * cp / cn) AS auprc FROM c GROUP BY 1)"""


@query(
    "auroc_auprc",
    f"""WITH {BINARY}, m AS (SELECT grp, sum(y) AS p, count(*) - sum(y) AS n, sum(CASE WHEN y = 1 THEN mid END) AS rs, count(*) FILTER (yhat AND y = 1) AS tp, count(*) FILTER (yhat) AS pp, count(*) FILTER (yhat = (y = 1)) AS ok, count(*) AS al FROM r GROUP BY 1)
SELECT grp, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) END, 6) AS auroc, round(CASE WHEN p > 0 AND n > 0 THEN auprc END, 6) AS auprc, round(ok::DOUBLE / al, 6) AS accuracy, round(tp::DOUBLE / nullif(pp, 0), 6) AS precision, round(tp::DOUBLE / nullif(p, 0), 6) AS recall FROM m JOIN ap USING (grp)""",
)
def auroc_auprc(spark, sf_dir):
    """By mid-ranks and by precision at every distinct threshold; NULL for one class."""
    d, lab = v.table(spark, sf_dir, "documents"), v.table(spark, sf_dir, "labels").where("quality is not null")
    b = d.join(lab, "doc_id").select(F.col("lang").alias("grp"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"), (F.col("n_chars") > 1500).alias("yhat"))
    y, hat = F.col("y") == 1, F.col("yhat")
    one = lambda c: c.cast("long")
    # Every different score once, with its rows and those up to it.
    u = value_ranks(b, ["grp"], "s", p=one(y), tp=one(hat & y), pp=one(hat), ok=one(hat == y))
    m = u.groupBy("grp").agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("n"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("mid"))).alias("rs"), *(F.sum(c).alias(c) for c in ("tp", "pp", "ok")), F.sum("n").alias("al"))
    from_top = lambda c: F.col(f"all_{c}") - F.col(f"{c}_upto") + F.col(c)
    whole = m.select("grp", F.col("p").alias("all_p"), F.col("al").alias("all_n"))
    ap = u.join(whole, "grp").groupBy("grp").agg(F.sum(F.expr("try_divide(p, all_p)") * from_top("p") / from_top("n")).alias("ap"))
    two = (F.col("p") > 0) & (F.col("n") > 0)
    share = lambda a, c: v.r6(F.expr(f"try_divide(cast({a} as double), {c})"))
    return m.join(ap, "grp").select("grp", v.r6(F.when(two, (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")))).alias("auroc"), v.r6(F.when(two, F.col("ap"))).alias("auprc"), share("ok", "al").alias("accuracy"), share("tp", "pp").alias("precision"), share("tp", "p").alias("recall"))


@query("direction_classes", f"WITH {v.LOO} SELECT count(*) AS n, count(*) FILTER (abs(pred) > 0.01 AND abs(delta) > 0.05) AS tp, count(*) FILTER (abs(pred) > 0.01) AS predicted, count(*) FILTER (abs(delta) > 0.05) AS de, count(*) FILTER (sign(pred) = sign(delta)) AS same_sign FROM loo")
def direction_classes(spark, sf_dir):
    """Changed and direction calls pooled over all rows."""
    p, t = F.abs("pred") > 0.01, F.abs("delta") > 0.05
    return loo(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(p & t).alias("tp"), F.count_if(p).alias("predicted"), F.count_if(t).alias("de"), F.count_if(F.signum("pred") == F.signum("delta")).alias("same_sign"))


@query(
    "ranksum_de",
    """WITH x AS (SELECT l_returnflag AS g, l_shipdate, l_suppkey % 10 AS gene, l_quantity + l_discount AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT g, gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0::DOUBLE AS mid FROM x),
s AS (SELECT gene, count(*) FILTER (g = 'A') AS n1, count(*) FILTER (g = 'R') AS n2, sum(CASE WHEN g = 'A' THEN mid END) AS rs FROM r GROUP BY 1)
SELECT gene, n1, n2, round(rs - n1 * (n1 + 1) / 2.0::DOUBLE, 4) AS u, round((rs - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM s""",
)
def ranksum_de(spark, sf_dir):
    """Mann-Whitney U and its normal score without tie correction."""
    x = v.table(spark, sf_dir, "lineitem").where("l_returnflag in ('A', 'R')").select(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") % 10).alias("gene"), (F.col("l_quantity") + F.col("l_discount")).alias("x"))
    r = value_ranks(x, ["gene"], "x", n1=(F.col("g") == "A").cast("long"))
    s = r.groupBy("gene").agg(F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"), F.sum(F.col("n1") * F.col("mid")).alias("rs"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("rs") - n1 * (n1 + 1) / 2
    return s.select("gene", "n1", "n2", F.round(u, 4).alias("u"), v.r6((u - n1 * n2 / 2) / F.sqrt(n1.cast("double") * n2 * (n1 + n2 + 1) / 12)).alias("z"))


PAIRED = f"""{v.LOO}, g AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS a, {v.sql_pearson('control_mean', 'delta')} AS b FROM loo GROUP BY 1), d AS (SELECT pert, round(a - b, 9) AS e FROM g)"""


def paired_differences(spark, sf_dir) -> DataFrame:
    t = F.col("delta")
    g = loo(spark, sf_dir).groupBy("pert").agg(stats.pearson(F.col("pred"), t).alias("a"), stats.pearson(F.col("control_mean"), t).alias("b"))
    return g.select("pert", F.round(F.col("a") - F.col("b"), 9).alias("e"))


@query(
    "paired_compare",
    f"""WITH {PAIRED}, s AS (SELECT (pert % 3)::INT AS cat, count(*) AS n, avg(e) AS gain, stddev_samp(e) / sqrt(count(*)) AS se, count(*) FILTER (e > 0) AS wins, count(*) FILTER (e = 0) AS ties FROM d GROUP BY 1)
SELECT cat, n, round(gain, 6) AS gain, round(se, 6) AS se, wins, ties, CASE WHEN n < 3 THEN NULL WHEN gain > 2 * se AND wins > n / 2.0 THEN 'a' WHEN -gain > 2 * se AND wins < n / 2.0 THEN 'b' ELSE 'none' END AS verdict FROM s""",
)
def paired_compare(spark, sf_dir):
    """Mean difference, its error, wins and a verdict."""
    s = paired_differences(spark, sf_dir).groupBy((F.col("pert") % 3).cast("int").alias("cat")).agg(F.count("*").alias("n"), F.avg("e").alias("gain"), (F.stddev_samp("e") / F.sqrt(F.count("*"))).alias("se"), F.count_if(F.col("e") > 0).alias("wins"), F.count_if(F.col("e") == 0).alias("ties"))
    return s.select("cat", "n", v.r6("gain").alias("gain"), v.r6("se").alias("se"), "wins", "ties", stats.verdict(F.col("gain"), F.col("se"), F.col("wins"), F.col("n")).alias("verdict"))


@query("overlap_se", f"WITH {PAIRED}, c AS (SELECT pert, e - avg(e) OVER () AS e FROM d), o AS (SELECT sum(a.e * b.e) AS x FROM c a JOIN c b ON a.pert % 4 = b.pert % 4) SELECT round(sqrt(greatest(0, max(x) / sum(e * e))), 6) AS ratio FROM c, o")
def overlap_se(spark, sf_dir):
    """Error ratio when groups that share a target move together; by sums over the shared target."""
    d = paired_differences(spark, sf_dir)
    c = d.crossJoin(F.broadcast(d.agg(F.avg("e").alias("m")))).select("pert", (F.col("e") - F.col("m")).alias("e"))  # one row
    s = c.groupBy((F.col("pert") % 4).alias("target")).agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    return s.agg(v.r6(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("s") * F.col("s")) / F.sum("q")))).alias("ratio"))


@query("spearman_table", "WITH r AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part) SELECT p_type, round(CASE WHEN count(*) >= 3 THEN corr(a, b) END, 6) AS rho FROM r GROUP BY 1")
def spearman_table(spark, sf_dir):
    """M15."""
    part = v.table(spark, sf_dir, "part").select("p_type", "p_size", "p_retailprice")
    rank = lambda c, name: value_ranks(part, ["p_type"], c).select("p_type", c, F.col("mid").alias(name))
    r = part.join(rank("p_size", "a"), ["p_type", "p_size"]).join(rank("p_retailprice", "b"), ["p_type", "p_retailprice"])
    return r.groupBy("p_type").agg(v.r6(F.when(F.count("*") >= 3, stats.pearson(F.col("a"), F.col("b")))).alias("rho"))


@query(
    "hypergeometric_tail",
    """WITH g AS (SELECT source, count(*) AS m, count(*) FILTER (n_chars > 3000) AS hit FROM documents GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (n_chars > 3000) AS k FROM documents)
SELECT source, hit, round((SELECT sum(exp(lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) + lgamma(n - m + 1) - lgamma(k - x + 1) - lgamma(n - m - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) FROM (SELECT unnest(range(hit, least(m, k) + 1)) AS x) WHERE k - x <= n - m), 5) AS p FROM g, t WHERE hit >= 3""",
)
def hypergeometric_tail(spark, sf_dir):
    """P(X >= hit), a row a term of the tail, from the logarithm of the gamma function."""
    d = v.table(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.count("*").alias("m"), F.count_if(F.col("n_chars") > 3000).alias("hit")).where("hit >= 3")
    t = d.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 3000).alias("k"))
    rows = g.crossJoin(F.broadcast(t)).withColumn("x", F.explode(F.sequence(F.greatest("hit", F.col("k") + F.col("m") - F.col("n")), F.least("m", "k"))))  # one row
    n, k, m, x = (F.col(c) for c in "nkmx")
    term = stats.log_choose(m, x) + stats.log_choose(n - m, k - x) - stats.log_choose(n, k)
    return rows.groupBy("source", "hit").agg(F.round(F.sum(F.exp(term)), 5).alias("p"))


@query(
    "split_half_reliability",
    f"""WITH {v.NORM}, h AS (SELECT norm.*, rep, substr(sha256(cell::VARCHAR || ':' || rep), 1, 1) < '8' AS half FROM norm, (SELECT unnest(range(1, 6)) AS rep)), n AS (SELECT rep, pert, half, count(DISTINCT cell) AS n FROM h GROUP BY 1, 2, 3),
m AS (SELECT rep, pert, gene, sum(CASE WHEN half THEN x ELSE 0 END) AS a, sum(CASE WHEN NOT half THEN x ELSE 0 END) AS b FROM h GROUP BY 1, 2, 3),
p AS (SELECT m.rep, m.pert, gene, a / x.n AS a, b / y.n AS b FROM m JOIN n x ON x.rep = m.rep AND x.pert = m.pert AND x.half JOIN n y ON y.rep = m.rep AND y.pert = m.pert AND NOT y.half),
c AS (SELECT rep, gene, (a + b) / 2 AS c FROM p WHERE pert = 0), r AS (SELECT rep, pert, {v.sql_pearson('a - c', 'b - c')} AS r FROM p JOIN c USING (rep, gene) WHERE pert <> 0 GROUP BY 1, 2)
SELECT pert, round(avg(r), 5) AS r, round(avg(CASE WHEN 1 + r > 0 THEN 2 * r / (1 + r) ELSE -1.0 END), 5) AS reliability FROM r GROUP BY 1""",
)
def split_half_reliability(spark, sf_dir):
    """Mean correlation of half means over five hash halves, stepped up to full length."""
    reps = range(1, 6)
    x = v.normalised(v.counts(spark, sf_dir))
    half = {k: F.substring(F.sha2(F.concat(F.col("cell").cast("string"), F.lit(f":{k}")), 256), 1, 1) < "8" for k in reps}
    cells = x.select("pert", "cell").distinct()
    # One pass for all halves: a pair of sums each.
    n = cells.groupBy("pert").agg(*(F.count_if(c == side).alias(f"n{k}{side}") for k, c in half.items() for side in (True, False)))
    m = x.groupBy("pert", "gene").agg(*(F.sum(F.when(c == side, F.col("x")).otherwise(0.0)).alias(f"s{k}{side}") for k, c in half.items() for side in (True, False)))
    sides = F.array(*(F.struct(F.lit(k).alias("rep"), (F.col(f"s{k}True") / F.col(f"n{k}True")).alias("a"), (F.col(f"s{k}False") / F.col(f"n{k}False")).alias("b")) for k in reps))
    p = m.join(n, "pert").select("pert", "gene", F.inline(sides))
    c = p.where("pert = 0").select("rep", "gene", ((F.col("a") + F.col("b")) / 2).alias("c"))
    r = p.where("pert <> 0").join(c, ["rep", "gene"]).groupBy("rep", "pert").agg(stats.pearson(F.col("a") - F.col("c"), F.col("b") - F.col("c")).alias("r"))
    return r.groupBy("pert").agg(F.round(F.avg("r"), 5).alias("r"), F.round(F.avg(stats.spearman_brown(F.col("r"), 2)), 5).alias("reliability"))


@query("ceiling_gap", f"WITH {v.LOO}, a AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS r, {v.sql_pearson('mean', 'control_mean')} AS c FROM loo GROUP BY 1) SELECT pert, round(c - r, 6) AS gap, round(CASE WHEN c > 0 THEN r / c END, 6) AS share FROM a")
def ceiling_gap(spark, sf_dir):
    """Achieved against a ceiling."""
    a = loo(spark, sf_dir).groupBy("pert").agg(stats.pearson(F.col("pred"), F.col("delta")).alias("r"), stats.pearson(F.col("mean"), F.col("control_mean")).alias("c"))
    return a.select("pert", v.r6(F.col("c") - F.col("r")).alias("gap"), v.r6(F.when(F.col("c") > 0, F.col("r") / F.col("c"))).alias("share"))


@query("best_neighbour", f"WITH {v.DELTA}, w AS (SELECT a.pert AS p, b.pert AS q, {v.sql_pearson('a.delta', 'b.delta')} AS r FROM delta a JOIN delta b ON a.gene = b.gene AND a.pert <> b.pert GROUP BY 1, 2) SELECT p AS pert, round(max(r), 6) AS best FROM w GROUP BY 1")
def best_neighbour(spark, sf_dir):
    """The best single neighbour as a hindsight ceiling."""
    from quillon.operators.linear import group_correlations

    w = group_correlations(v.delta_view(spark, sf_dir))
    return w.groupBy(F.col("p").alias("pert")).agg(v.r6(F.max("r")).alias("best"))


@query("mix_ceilings")
def mix_ceilings(spark, sf_dir):
    """Hindsight ceilings of the best single group, the best non-negative mix and the best free mix."""
    from quillon.operators import linear

    return linear.mix_ceilings(v.delta_view(spark, sf_dir))


@query(
    "metric_calibration",
    f"""WITH {v.LOO}, u AS (SELECT 'delta' AS def, pert, pred AS p, delta AS t FROM loo UNION ALL SELECT 'level', pert, pred + control_mean, mean FROM loo UNION ALL SELECT 'log', pert, ln(1 + abs(pred)), ln(1 + abs(delta)) FROM loo)
SELECT def, round({v.sql_pearson('p', 't')}, 6) AS pooled, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse FROM u GROUP BY 1""",
)
def metric_calibration(spark, sf_dir):
    """One metric under several definitions, pooled."""
    p, t, c = F.col("pred"), F.col("delta"), F.col("control_mean")
    defs = F.array(*(F.struct(F.lit(n).alias("def"), a.alias("p"), b.alias("t")) for n, a, b in (("delta", p, t), ("level", p + c, F.col("mean")), ("log", F.log1p(F.abs(p)), F.log1p(F.abs(t))))))
    u = loo(spark, sf_dir).select(F.inline(defs))
    return u.groupBy("def").agg(v.r6(stats.pearson(F.col("p"), F.col("t"))).alias("pooled"), v.r6(stats.rmse(F.col("t"), F.col("p"))).alias("rmse"))


@query(
    "null_summary",
    "WITH r AS (SELECT user_id AS f, event_id AS b, value AS g FROM events), o AS (SELECT f, max(g) * 0.9 AS obs FROM r GROUP BY 1) SELECT f, count(*) AS reps, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, round(quantile_cont(g, 0.95), 6) AS p95, round((1 + count(*) FILTER (g >= obs))::DOUBLE / (count(*) + 1), 6) AS p FROM r JOIN o USING (f) GROUP BY 1",
)
def null_summary(spark, sf_dir):
    """Replicates against the observed value."""
    r = v.table(spark, sf_dir, "events").select(F.col("user_id").alias("f"), F.col("value").alias("g"))
    o = r.groupBy("f").agg((F.max("g") * 0.9).alias("obs"))
    return r.join(o, "f").groupBy("f").agg(F.count("*").alias("reps"), v.r6(F.avg("g")).alias("mean"), v.r6(F.stddev_samp("g")).alias("sd"), v.r6(F.percentile("g", F.lit(0.95))).alias("p95"), v.r6((1 + F.count_if(F.col("g") >= F.col("obs"))) / (F.count("*") + 1)).alias("p"))


@query("feature_verdict", "WITH f AS (SELECT user_id AS f, avg(value) AS m, count(*) AS n, stddev_samp(value) AS s FROM events GROUP BY 1) SELECT f, array_to_string(list_filter([CASE WHEN m < 45 THEN 'gain' END, CASE WHEN n < 60 THEN 'too few' END, CASE WHEN s > 30 THEN 'noise' END], lambda x: x IS NOT NULL), ';') AS failures FROM f")
def feature_verdict(spark, sf_dir):
    """Conjunctive criteria, with the names of those that fail. Means and deviations are compared to nine decimals, so that the order of a sum decides nothing at a limit."""
    f = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("f")).agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.stddev_samp("value").alias("s"))
    return f.select("f", F.array_join(F.array_compact(F.array(F.when(F.round("m", 9) < 45, "gain"), F.when(F.col("n") < 60, "too few"), F.when(F.round("s", 9) > 30, "noise"))), ";").alias("failures"))


@query("equivalence_class", "WITH f AS (SELECT user_id AS f, avg(value) - 50 AS d, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1) SELECT f, CASE WHEN abs(d) <= 2 * se THEN 'not_established' WHEN abs(d) < 3 THEN 'below_margin' WHEN d > 0 THEN 'higher' ELSE 'lower' END AS class FROM f")
def equivalence_class(spark, sf_dir):
    """M23."""
    f = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("f")).agg((F.avg("value") - 50).alias("d"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    d = F.col("d")
    return f.select("f", F.when(F.abs(d) <= 2 * F.col("se"), "not_established").when(F.abs(d) < 3, "below_margin").when(d > 0, "higher").otherwise("lower").alias("class"))


@query(
    "one_se_choice",
    "WITH s AS (SELECT event_type AS fam, user_id % 15 AS size, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS se FROM events GROUP BY 1, 2), b AS (SELECT fam, max(round(m, 9)) AS best, arg_max(se, round(m, 9)) AS bse FROM s GROUP BY 1) SELECT s.fam, min(size) AS choice FROM s JOIN b USING (fam) WHERE m >= best - greatest(bse, 0.5) GROUP BY 1",
)
def one_se_choice(spark, sf_dir):
    """The smallest set within one error (or a floor) of the best."""
    s = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("fam"), (F.col("user_id") % 15).alias("size")).agg(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    b = s.groupBy("fam").agg(F.max(F.struct(F.round("m", 9).alias("m"), "se")).alias("b"))
    return s.join(b, "fam").where("m >= b.m - greatest(b.se, 0.5D)").groupBy("fam").agg(F.min("size").alias("choice"))


@query("development_gate", "WITH r AS (SELECT event_type AS f, user_id % 3 AS rep, avg(value) - 48 AS gain, stddev_samp(value) / 40 AS sd FROM events GROUP BY 1, 2) SELECT f, bool_and(gain > greatest(0.1, sd)) AS passes, count(*) AS repeats FROM r GROUP BY 1")
def development_gate(spark, sf_dir):
    """The gain must exceed its threshold in every repeat."""
    r = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("f"), (F.col("user_id") % 3).alias("rep")).agg((F.avg("value") - 48).alias("gain"), (F.stddev_samp("value") / 40).alias("sd"))
    return r.groupBy("f").agg(F.bool_and(F.col("gain") > F.greatest(F.lit(0.1), F.col("sd"))).alias("passes"), F.count("*").alias("repeats"))


@query("model_disagreement", f"WITH {v.LOO} SELECT pert, round(sqrt(sum((pred - delta) * (pred - delta))), 6) AS l2, round(sqrt(sum((pred - delta) * (pred - delta))) / nullif(sqrt(sum(delta * delta)), 0), 6) AS relative, count(*) AS n FROM loo WHERE abs(delta) >= 0.02 GROUP BY 1")
def model_disagreement(spark, sf_dir):
    """M26."""
    e = F.col("pred") - F.col("delta")
    l2 = F.sqrt(F.sum(e * e))
    return loo(spark, sf_dir).where("abs(delta) >= 0.02").groupBy("pert").agg(v.r6(l2).alias("l2"), v.r6(l2 / F.nullif(F.sqrt(F.sum(F.col("delta") * F.col("delta"))), F.lit(0.0))).alias("relative"), F.count("*").alias("n"))


@query("false_positive_rate", "WITH p AS (SELECT user_id, event_type, (1 + count(*) FILTER (value > 97))::DOUBLE / (1 + count(*)) AS p FROM events GROUP BY 1, 2) SELECT event_type, round(avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS rate FROM p GROUP BY 1")
def false_positive_rate(spark, sf_dir):
    """M27."""
    p = v.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(((1 + F.count_if(F.col("value") > 97)) / (1 + F.count("*"))).alias("p"))
    return p.groupBy("event_type").agg(v.r6(F.avg((F.col("p") <= 0.05).cast("double"))).alias("rate"))


@query("subset_scoring", f"WITH {v.LOO}, g AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS r FROM loo GROUP BY 1) SELECT sub, count(*) AS n, round(avg(r), 6) AS r FROM (SELECT 'all' AS sub, r FROM g UNION ALL SELECT CASE WHEN pert % 2 = 0 THEN 'in' ELSE 'other' END, r FROM g) GROUP BY 1")
def subset_scoring(spark, sf_dir):
    """Strata membership exploded, each scored."""
    g = loo(spark, sf_dir).groupBy("pert").agg(stats.pearson(F.col("pred"), F.col("delta")).alias("r"))
    sub = F.explode(F.array(F.lit("all"), F.when(F.col("pert") % 2 == 0, "in").otherwise("other")))
    return g.select("r", sub.alias("sub")).groupBy("sub").agg(F.count("*").alias("n"), v.r6(F.avg("r")).alias("r"))


@query("block_difference", f"WITH {v.LOO} SELECT gene, round(max(abs(pred - delta)) / greatest(stddev_pop(pred), stddev_pop(delta), 1e-6 * max(greatest(abs(pred), abs(delta)))), 5) AS spread FROM loo GROUP BY 1")
def block_difference(spark, sf_dir):
    """Largest difference in units of the columns' spread."""
    p, t = F.col("pred"), F.col("delta")
    return loo(spark, sf_dir).groupBy("gene").agg(F.round(F.max(F.abs(p - t)) / F.greatest(F.stddev_pop(p), F.stddev_pop(t), 1e-6 * F.max(F.greatest(F.abs(p), F.abs(t)))), 5).alias("spread"))


@query("selection_replay", "WITH s AS (SELECT event_type AS run, user_id AS m, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS sel, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS sco FROM events GROUP BY 1, 2) SELECT run, m, round(sco, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(sel, 9) DESC NULLS LAST, m) AS r FROM s) WHERE r = 1")
def selection_replay(spark, sf_dir):
    """Choose on one tier, score on the other."""
    even = F.col("event_id") % 2 == 0
    s = v.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("m")).agg(F.round(F.avg(F.when(even, F.col("value"))), 9).alias("sel"), F.avg(F.when(~even, F.col("value"))).alias("sco"))
    best = F.row_number().over(Window.partitionBy("run").orderBy(F.col("sel").desc_nulls_last(), "m"))
    return s.withColumn("r", best).where("r = 1").select("run", "m", v.r6("sco").alias("score"))


@query("verdict_table", "WITH f AS (SELECT user_id AS f, count(*) AS n, avg(value) AS m, max(value) AS x FROM events GROUP BY 1) SELECT f, CASE WHEN n < 40 THEN 'unstable' WHEN m > 52 THEN 'kept' WHEN m < 46 THEN 'harmful' WHEN x < 99 THEN 'redundant' ELSE 'no_gain' END AS verdict FROM f")
def verdict_table(spark, sf_dir):
    """The first rule that applies wins."""
    f = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("f")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("value").alias("x"))
    return f.select("f", F.when(F.col("n") < 40, "unstable").when(F.col("m") > 52, "kept").when(F.col("m") < 46, "harmful").when(F.col("x") < 99, "redundant").otherwise("no_gain").alias("verdict"))


@query("normal_p_values", f"WITH {PAIRED}, s AS (SELECT (pert % 4)::INT AS part, avg(e) / (stddev_samp(e) / sqrt(count(*))) AS z FROM d GROUP BY 1), t AS (SELECT part, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM s) SELECT part, round(z, 5) AS z, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2), 6) AS p FROM t")
def normal_p_values(spark, sf_dir):
    """Score of a mean against its error, and its two-sided p."""
    s = paired_differences(spark, sf_dir).groupBy((F.col("pert") % 4).cast("int").alias("part")).agg((F.avg("e") / (F.stddev_samp("e") / F.sqrt(F.count("*")))).alias("z"))
    return s.select("part", F.round("z", 5).alias("z"), v.r6(2 * stats.normal_sf(F.abs("z"))).alias("p"))


@query("number_traceability", "WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\d+')) AS n FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\d+')) AS n FROM documents) SELECT (SELECT count(*) FROM a) AS numbers, (SELECT count(*) FROM a WHERE n NOT IN (SELECT n FROM b)) AS untraced")
def number_traceability(spark, sf_dir):
    """Numbers that occur in no source."""
    numbers = lambda t: v.table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))).alias("n")).distinct()
    a = numbers("benchmark").join(numbers("documents").withColumn("there", F.lit(1)), "n", "left")
    return a.agg(F.count("*").alias("numbers"), F.count_if(F.col("there").isNull()).alias("untraced"))


@query("arm_rule")
def arm_rule_query(spark, sf_dir):
    """Verdict of an arm over its runs (needs a quantile of t)."""
    from quillon.operators.inference import arm_rule

    e = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("run"), (F.col("value") - 48).alias("d"))
    runs = e.groupBy("arm", "run").agg(F.avg("d").alias("g"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("s"), F.count_if(F.col("d") > 0).alias("wins_a"), F.count_if(F.col("d") < 0).alias("wins_b"), F.count("*").alias("pairs"))
    return arm_rule(runs, "arm", 30)


@query("welch_test")
def welch_test(spark, sf_dir):
    """Two-sided Welch test of two groups of runs."""
    from quillon.operators.inference import welch

    e = v.table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("side"), "value")
    return welch(e, "event_type", "side", "value")


@query(
    "overlap_jackknife",
    f"""WITH {PAIRED}, t AS (SELECT pert, pert % 4 AS gene, e FROM d), s AS (SELECT sum(e) AS se, count(*) AS n FROM t), j AS (SELECT gene, (max(s.se) - sum(e)) / (max(s.n) - count(*)) AS m, count(*) AS k FROM t, s GROUP BY 1)
SELECT round(sqrt((count(*) - 1)::DOUBLE / count(*) * sum((m - a) * (m - a))), 6) AS se FROM j, (SELECT avg(m) AS a FROM j)""",
)
def overlap_jackknife(spark, sf_dir):
    """Jackknife over shared targets: each target's groups left out together."""
    d = paired_differences(spark, sf_dir).select((F.col("pert") % 4).alias("gene"), "e")
    s = d.agg(F.sum("e").alias("se"), F.count("*").alias("n"))
    j = d.groupBy("gene").agg(F.sum("e").alias("own"), F.count("*").alias("k")).crossJoin(F.broadcast(s)).select(((F.col("se") - F.col("own")) / (F.col("n") - F.col("k"))).alias("m"))  # one row
    n = F.count("*")
    return j.agg(v.r6(F.sqrt((n - 1) / n * F.var_pop("m") * n)).alias("se"))


@query(
    "candidate_package",
    f"""WITH {v.LOO}, g AS (SELECT pert, sqrt(sum((pred - delta) * (pred - delta))) AS l2 FROM loo GROUP BY 1), k AS (SELECT pert, l2, row_number() OVER (ORDER BY round(l2, 9) DESC, pert) AS r FROM g)
SELECT pert, r, round(l2, 6) AS l2, CASE WHEN r <= 5 THEN 'candidate' ELSE 'negative' END AS role FROM k WHERE r <= 10""",
)
def candidate_package(spark, sf_dir):
    """The targets of largest disagreement and as many further ones (a top-k report)."""
    e = F.col("pred") - F.col("delta")
    g = loo(spark, sf_dir).groupBy("pert").agg(F.round(F.sqrt(F.sum(e * e)), 9).alias("l2")).orderBy(F.desc("l2"), "pert").limit(10)
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("l2"), "pert")).cast("long")  # ten rows
    return g.select("pert", r.alias("r"), v.r6("l2").alias("l2")).withColumn("role", F.when(F.col("r") <= 5, "candidate").otherwise("negative"))


@query("foreign_coverage", f"WITH {v.LOO} SELECT count(*) AS n, count(*) FILTER (pert % 6 = 1) AS missing, round({v.sql_pearson('CASE WHEN pert % 6 <> 1 THEN pred END', 'CASE WHEN pert % 6 <> 1 THEN delta END')}, 6) AS r FROM loo")
def foreign_coverage(spark, sf_dir):
    """Another model's rows, what they lack, and their score where they are."""
    there = F.col("pert") % 6 != 1
    return loo(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(~there).alias("missing"), v.r6(stats.pearson(F.when(there, F.col("pred")), F.when(there, F.col("delta")))).alias("r"))
