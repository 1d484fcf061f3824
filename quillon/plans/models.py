"""Linear models from sufficient statistics, kernels, decompositions (L rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import linear, nested, residuals, selection

from . import views as v
from .registry import query

#: Two columns and an intercept by explicit normal equations.
RIDGE = """s AS (SELECT {key} count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) * count(*) AS sxx, covar_pop(x, z) * count(*) AS sxz, covar_pop(z, z) * count(*) AS szz, covar_pop(x, y) * count(*) AS sxy, covar_pop(z, y) * count(*) AS szy FROM d {group}),
w AS (SELECT *, ((szz + {alpha}) * sxy - sxz * szy) / ((sxx + {alpha}) * (szz + {alpha}) - sxz * sxz) AS bx, ((sxx + {alpha}) * szy - sxz * sxy) / ((sxx + {alpha}) * (szz + {alpha}) - sxz * sxz) AS bz FROM s)"""


@query(
    "ridge_sql_2col",
    "WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount * 100 AS z, l_extendedprice / 1000 AS y FROM lineitem), " + RIDGE.format(key="g,", group="GROUP BY g", alpha="10.0") + " SELECT g, round(bx, 6) AS bx, round(bz, 6) AS bz, round(my - bx * mx - bz * mz, 5) AS b0 FROM w",
)
def ridge_sql_2col(spark, sf_dir):
    """Ridge weights from grouped sums."""
    d = v.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))
    return linear.ridge_two(d, ["g"], 10.0).select("g", v.r6("bx").alias("bx"), v.r6("bz").alias("bz"), F.round("b0", 5).alias("b0"))


@query(
    "fit_predict_score",
    f"""WITH {v.LOO}, d AS (SELECT pred AS x, control_mean AS z, delta AS y FROM loo WHERE pert % 5 < 3), {RIDGE.format(key="", group="", alpha="0.1")}
SELECT pert, round({v.sql_pearson('my + bx * (pred - mx) + bz * (control_mean - mz)', 'delta')}, 5) AS r FROM loo, w WHERE pert % 5 >= 3 GROUP BY 1""",
)
def fit_predict_score(spark, sf_dir):
    """Fit on training groups, predict and score the others."""
    d = v.loo_mean(v.delta_view(spark, sf_dir))
    w = linear.ridge_two(d.where("pert % 5 < 3").select(F.col("pred").alias("x"), F.col("control_mean").alias("z"), F.col("delta").alias("y")), [], 0.1)
    rows = d.where("pert % 5 >= 3").crossJoin(F.broadcast(w))  # one row of weights
    fit = F.col("b0") + F.col("bx") * F.col("pred") + F.col("bz") * F.col("control_mean")
    return rows.groupBy("pert").agg(F.round(stats.pearson(fit, F.col("delta")), 5).alias("r"))


@query(
    "kfold_ridge",
    f"""WITH {v.LOO}, f AS (SELECT unnest(range(4))::INT AS fold), d AS (SELECT fold, pred AS x, control_mean AS z, delta AS y FROM loo, f WHERE pert % 4 <> fold), {RIDGE.format(key="fold,", group="GROUP BY fold", alpha="0.1")}
SELECT fold, round(sqrt(avg(pow(delta - my - bx * (pred - mx) - bz * (control_mean - mz), 2))), 6) AS rmse FROM loo JOIN w ON w.fold = pert % 4 GROUP BY 1""",
)
def kfold_ridge(spark, sf_dir):
    """Every fold's fit leaves out its own groups; folds by arithmetic, weights by grouped sums."""
    d = v.loo_mean(v.delta_view(spark, sf_dir))
    folds = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))
    w = linear.ridge_two(folds.where("pert % 4 <> fold").select("fold", F.col("pred").alias("x"), F.col("control_mean").alias("z"), F.col("delta").alias("y")), ["fold"], 0.1)
    e = F.col("delta") - F.col("b0") - F.col("bx") * F.col("pred") - F.col("bz") * F.col("control_mean")
    return d.withColumn("fold", (F.col("pert") % 4).cast("int")).join(w, "fold").groupBy("fold").agg(v.r6(F.sqrt(F.avg(e * e))).alias("rmse"))


@query("statistics_pearson", "WITH s AS (SELECT l_suppkey AS g, count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice * l_extendedprice) AS syy, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem GROUP BY 1) SELECT g, round((sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 6) AS r FROM s WHERE n > 1")
def statistics_pearson(spark, sf_dir):
    """Scores from sums, without predictions."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")).where("n > 1")
    c = F.col
    return s.select("g", v.r6((c("sxy") - c("sx") * c("sy") / c("n")) / F.sqrt((c("sxx") - c("sx") * c("sx") / c("n")) * (c("syy") - c("sy") * c("sy") / c("n")))).alias("r"))


@query("honest_choice", "WITH s AS (SELECT user_id % 5 AS alpha, event_id % 3 AS seed, avg(value) AS m FROM events GROUP BY 1, 2), b AS (SELECT seed, alpha FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(m, 9) DESC, alpha) AS r FROM s) WHERE r = 1) SELECT b.seed AS chosen_on, s.seed AS reported_on, b.alpha, round(s.m, 6) AS score FROM b JOIN s ON s.alpha = b.alpha AND s.seed <> b.seed")
def honest_choice(spark, sf_dir):
    """The penalty is chosen on one seed and reported on the others."""
    s = v.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("alpha"), (F.col("event_id") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    b = s.groupBy(F.col("seed").alias("chosen_on")).agg(F.min_by("alpha", F.struct(-F.round("m", 9), "alpha")).alias("alpha"))
    return b.join(s, "alpha").where("seed <> chosen_on").select("chosen_on", F.col("seed").alias("reported_on"), "alpha", v.r6("m").alias("score"))


@query("single_and_drop_one", f"WITH {v.LOO} SELECT 'pred' AS feature, round({v.sql_pearson('pred', 'delta')}, 6) AS single FROM loo UNION ALL SELECT 'control', round({v.sql_pearson('control_mean', 'delta')}, 6) FROM loo UNION ALL SELECT 'cells', round({v.sql_pearson('n_cells', 'delta')}, 6) FROM loo")
def single_and_drop_one(spark, sf_dir):
    """Each column alone, in one pass."""
    pairs = {"pred": F.col("pred"), "control": F.col("control_mean"), "cells": F.col("n_cells").cast("double")}
    row = v.loo_mean(v.delta_view(spark, sf_dir)).agg(*(stats.pearson(c, F.col("delta")).alias(k) for k, c in pairs.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), v.r6(k).alias("single")) for k in pairs))))


@query("forward_selection")
def forward_selection(spark, sf_dir):
    """Greedy forward path over six columns from one Gram matrix."""
    return linear.forward_path(linear.design(v.loo_mean(v.delta_view(spark, sf_dir))), "y", alpha=0.1)


@query("lasso_path")
def lasso_path(spark, sf_dir):
    """Coordinate descent on the Gram matrix over a penalty grid."""
    return linear.lasso_path(linear.design(v.loo_mean(v.delta_view(spark, sf_dir))), "y", [1.0, 0.3, 0.1, 0.03, 0.01])


COLUMNS = ["pred", "control", "cells", "product", "square", "level"]


def _folded(spark, sf_dir):
    """The design with its group, and the groups dealt to four folds."""
    return linear.design(v.loo_mean(v.delta_view(spark, sf_dir)), "pert").withColumn("fold", (F.col("pert") % 4).cast("int"))


@query("subset_scores")
def subset_scores(spark, sf_dir):
    """Each column alone and the full model without it, from moments by group and fold."""
    rows = selection.Subsets(_folded(spark, sf_dir), "pert", "fold", COLUMNS, "y", 1.0).single_and_drop_one()
    return spark.createDataFrame([(c, *(round(x, 6) for x in r)) for c, *r in rows], "column string, single double, full double, drop_one double")  # a row a column


@query("greedy_paths")
def greedy_paths(spark, sf_dir):
    """Forward and backward paths over the same memo of scored subsets."""
    engine = selection.Subsets(_folded(spark, sf_dir), "pert", "fold", COLUMNS, "y", 1.0)
    rows = [(kind, size, c, round(r, 6)) for kind in ("forward", "backward") for size, c, r in engine.path(kind == "forward")]
    return spark.createDataFrame(rows, "path string, size int, column string, score double")  # a row a step


@query("lasso_cv")
def lasso_cv(spark, sf_dir):
    """Out-of-fold error of a lasso over a grid of penalties, and the one that is chosen."""
    grid, k, _ = selection.lasso_cv(_folded(spark, sf_dir), "fold", COLUMNS, "y")
    return spark.createDataFrame([(round(a, 9), round(e, 9), i == k) for i, (a, e) in enumerate(grid)], "penalty double, mse double, chosen boolean")  # a row a penalty


@query("lasso_stability")
def lasso_stability(spark, sf_dir):
    """How often halves of the groups keep each column at the chosen penalty."""
    return selection.lasso_stability(_folded(spark, sf_dir), "pert", "fold", COLUMNS, "y")


@query("column_rank")
def column_rank(spark, sf_dir):
    """Rank, effective rank and condition of a design with a copy, a mirrored scale and a constant."""
    return selection.column_rank(_columns(spark, sf_dir).drop("pert"), [*COLUMNS, "copy", "scaled", "fixed"])


@query("redundancy", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem) SELECT 'quantity' AS i, 'extendedprice' AS j, abs(a) >= 0.9 AS clustered, round(a, 6) AS r FROM c UNION ALL SELECT 'quantity', 'discount', abs(b) >= 0.9, round(b, 6) FROM c UNION ALL SELECT 'extendedprice', 'discount', abs(c) >= 0.9, round(c, 6) FROM c")
def redundancy(spark, sf_dir):
    """Column pairs that belong to one cluster."""
    pairs = [("quantity", "extendedprice"), ("quantity", "discount"), ("extendedprice", "discount")]
    row = v.table(spark, sf_dir, "lineitem").agg(*(F.corr(f"l_{i}", f"l_{j}").alias(f"{i}-{j}") for i, j in pairs))
    return row.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.abs(f"{i}-{j}") >= 0.9).alias("clustered"), v.r6(F.col(f"{i}-{j}")).alias("r")) for i, j in pairs))))


def _columns(spark, sf_dir):
    """The design with a copy, a mirrored scale and a constant among its columns, and the group."""
    d = linear.design(v.loo_mean(v.delta_view(spark, sf_dir)), "pert").drop("y")
    return d.withColumns({"copy": F.col("pred"), "scaled": 3 - 2 * F.col("control"), "fixed": F.lit(1.5)})


@query("column_clusters")
def column_clusters(spark, sf_dir):
    """Constant, duplicate, clustered and single columns of a design, from one Gram matrix."""
    return linear.redundancy(_columns(spark, sf_dir).drop("pert"))


@query("cluster_merge")
def cluster_merge(spark, sf_dir):
    """Clusters of columns merged to their first principal component, fitted on the training groups."""
    d = _columns(spark, sf_dir)
    return linear.merge_clusters(d.withColumn("pert", F.col("pert").cast("double")), "pert % 5 < 3").where("column <> 'pert'")


@query("residual_spectrum")
def residual_spectrum(spark, sf_dir):
    """Components of the residuals against a permutation null."""
    return residuals.residual_spectrum(v.loo_mean(v.delta_view(spark, sf_dir)), "pred", "delta")


@query("residual_structure")
def residual_structure(spark, sf_dir):
    """Shares of the residuals' components against permuted residuals, and whether one group makes a component."""
    return residuals.residual_structure(v.loo_mean(v.delta_view(spark, sf_dir)), "pred", "delta")


@query("residual_loadings")
def residual_loadings(spark, sf_dir):
    """Measures and groups with the largest loadings of the first two components."""
    return residuals.residual_loadings(v.loo_mean(v.delta_view(spark, sf_dir)), "pred", "delta")


@query("null_false_positives")
def null_false_positives(spark, sf_dir):
    """The false-positive rate of the permutation null over meaningless features."""
    return linear.null_false_positives(v.delta_view(spark, sf_dir), "delta")


@query("principal_components")
def principal_components(spark, sf_dir):
    """Components of the design's covariance with their shares, signs fixed by the largest loading."""
    return linear.components(linear.design(v.loo_mean(v.delta_view(spark, sf_dir))).drop("y"))


@query(
    "stacking",
    f"""WITH {v.LOO}, g AS (SELECT pert, sum(pred * delta) AS pt, sum(pred * pred) AS pp FROM loo GROUP BY 1), o AS (SELECT pert, (sum(pt) OVER () - pt) / (sum(pp) OVER () - pp + 0.5) AS w FROM g)
SELECT pert, round(w, 6) AS w FROM o""",
)
def stacking(spark, sf_dir):
    """Leave-one-group-out weights: the total less the group's own sums."""
    g = v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("pert").agg(F.sum(F.col("pred") * F.col("delta")).alias("pt"), F.sum(F.col("pred") * F.col("pred")).alias("pp"))
    t = g.agg(F.sum("pt").alias("tpt"), F.sum("pp").alias("tpp"))
    return g.crossJoin(F.broadcast(t)).select("pert", v.r6((F.col("tpt") - F.col("pt")) / (F.col("tpp") - F.col("pp") + 0.5)).alias("w"))  # one row


@query("stacking_choice")
def stacking_choice(spark, sf_dir):
    """Every group predicted by a stack of the others, whose penalty they choose among themselves."""
    d = linear.design(v.loo_mean(v.delta_view(spark, sf_dir)), "pert")
    return selection.stacks(d, "pert", ["pred", "control", "product"], "y", ALPHAS).withColumnRenamed("group", "pert")


@query("kernel_ridge_loo")
def kernel_ridge_loo(spark, sf_dir):
    """Kernel ridge over groups with closed-form leave-one-out errors for a penalty grid."""
    return linear.kernel_ridge_loo(v.delta_view(spark, sf_dir), [0.1, 1.0, 10.0])


def _similarity(spark, sf_dir):
    """(a, b, w): Jaccard similarity of the sets that the groups' targets are in, both orders."""
    from quillon.operators.joins import jaccard_of_members
    from quillon.plans.features import context

    c = context(spark, sf_dir)
    members = c.targets.join(c.sets, "gene").select("pert", "set_name").distinct()
    pairs = jaccard_of_members(members, "pert", "set_name").withColumnRenamed("jaccard", "w")
    return pairs.unionByName(pairs.selectExpr("b as a", "a as b", "w"))


ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


@query("nested_loo_protocol")
def nested_loo_protocol(spark, sf_dir):
    """Every group held out once; the stack's penalty is chosen by leave-one-out among the others."""
    return nested.nested_loo(v.delta_view(spark, sf_dir), _similarity(spark, sf_dir), ALPHAS)


@query("nested_loo_hidden")
def nested_loo_hidden(spark, sf_dir):
    """The same, where a held-out group hides the groups of its region as well."""
    nation = v.table(spark, sf_dir, "nation")
    hidden = nation.select(F.col("n_nationkey").alias("pert"), (F.col("n_regionkey") * 10 + F.col("n_nationkey") % 2).alias("r")).join(nation.select(F.col("n_nationkey").alias("other"), (F.col("n_regionkey") * 10 + F.col("n_nationkey") % 2).alias("r")), "r").select("pert", "other")
    return nested.nested_loo(v.delta_view(spark, sf_dir), _similarity(spark, sf_dir), ALPHAS, hidden=hidden)


#: The models of the factory with their penalties.
SPECS = [("ridge", 1.0), ("lasso", 0.001), ("elasticnet", 0.001), ("ols", 0.0)]


@query("model_factory")
def model_factory(spark, sf_dir):
    """Ridge, lasso, elastic net and least squares over all columns of the design, from one pass of sums."""
    d = linear.design(v.loo_mean(v.delta_view(spark, sf_dir)))
    return linear.fit_models(d, [c for c in d.columns if c != "y"], "y", SPECS)


@query("kfold_models")
def kfold_models(spark, sf_dir):
    """The models of the factory, each predicting the folds that its fit leaves out."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    d = linear.design(loo.withColumn("fold", (F.col("pert") % 4).cast("int")), "fold")
    columns = [c for c in d.columns if c not in ("y", "fold")]
    w = linear.fold_weights(d, "fold", columns, "y", SPECS)
    fit = F.col("b0") + sum((F.col(c) * F.col("w")[k] for k, c in enumerate(columns)), F.lit(0.0))
    e = F.col("y") - fit
    return d.join(w, "fold").groupBy("fold", "kind").agg(v.r6(F.sqrt(F.avg(e * e))).alias("rmse"), v.r6(stats.pearson(fit, F.col("y"))).alias("r"))


@query(
    "additive_rule",
    """WITH t AS (SELECT DISTINCT l_orderkey AS pert, l_suppkey AS target FROM lineitem), k AS (SELECT pert, count(*) AS n FROM t GROUP BY 1),
m AS (SELECT t.target, avg(o_totalprice / 1000) AS d FROM t JOIN k USING (pert) JOIN orders ON o_orderkey = t.pert WHERE n = 1 GROUP BY 1), f AS (SELECT avg(d) AS fill FROM m)
SELECT t.pert, round(sum(coalesce(m.d, fill)), 6) AS pred FROM t LEFT JOIN m USING (target), f GROUP BY 1""",
)
def additive_rule(spark, sf_dir):
    """Sum of the single changes of the targets, filled by the mean single change."""
    t = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pert"), F.col("l_suppkey").alias("target")).distinct()
    single = t.groupBy("pert").agg(F.count("*").alias("n"), F.first("target").alias("target")).where("n = 1")
    price = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pert"), (F.col("o_totalprice") / 1000).alias("d"))
    m = single.join(price, "pert").groupBy("target").agg(F.avg("d").alias("d"))
    fill = m.agg(F.avg("d").alias("fill"))
    return t.join(m, "target", "left").crossJoin(F.broadcast(fill)).groupBy("pert").agg(v.r6(F.sum(F.coalesce("d", "fill"))).alias("pred"))  # one row


@query("simple_baselines", f"WITH {v.LOO} SELECT pert, round(sqrt(avg(delta * delta)), 6) AS unperturbed, round(sqrt(avg((pred - delta) * (pred - delta))), 6) AS mean_response FROM loo GROUP BY 1")
def simple_baselines(spark, sf_dir):
    """L21, O13."""
    d, e = F.col("delta"), F.col("pred") - F.col("delta")
    return v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("pert").agg(v.r6(F.sqrt(F.avg(d * d))).alias("unperturbed"), v.r6(F.sqrt(F.avg(e * e))).alias("mean_response"))


@query("refit_with_visible", f"WITH {v.DELTA} SELECT gene, round(avg(CASE WHEN pert % 5 < 3 THEN delta END), 6) AS train, round(avg(CASE WHEN pert % 5 < 4 THEN delta END), 6) AS refit FROM delta GROUP BY 1")
def refit_with_visible(spark, sf_dir):
    """The fit on training groups, and with the visible ones added."""
    part = F.col("pert") % 5
    return v.delta_view(spark, sf_dir).groupBy("gene").agg(v.r6(F.avg(F.when(part < 3, F.col("delta")))).alias("train"), v.r6(F.avg(F.when(part < 4, F.col("delta")))).alias("refit"))


@query(
    "permutation_null_fast",
    f"""WITH {v.LOO}, o AS (SELECT pert, gene, pred, delta, row_number() OVER (PARTITION BY pert ORDER BY gene) AS i FROM loo),
t AS (SELECT pert, gene, i, b, row_number() OVER (PARTITION BY pert, b ORDER BY sha256(b || ':' || gene)) AS j FROM o, (SELECT unnest(range(999)) AS b)),
c AS (SELECT t.pert, b, sum(o.pred * y.delta) AS xy FROM t JOIN o ON o.pert = t.pert AND o.i = t.i JOIN o y ON y.pert = t.pert AND y.i = t.j GROUP BY 1, 2), s AS (SELECT pert, sum(pred * delta) AS obs FROM loo GROUP BY 1)
SELECT pert, round(any_value(obs), 6) AS observed, round((1 + count(*) FILTER (xy >= obs - 1e-12))::DOUBLE / 1000, 6) AS p FROM c JOIN s USING (pert) GROUP BY 1""",
)
def permutation_null_fast(spark, sf_dir):
    """999 permutations of the measures in hash order; only the cross term is recomputed."""
    return linear.permutation_null(v.loo_mean(v.delta_view(spark, sf_dir)), "pred", "delta", 999).select("pert", "observed", "p")


COEF = [("m1", 0.7, "pred", 0.0, 0.05, 1.2), ("m1", 0.7, "control_mean", 0.5, 0.2, -0.1), ("m2", 0.3, "pred", 0.01, 0.04, 0.9)]


@query("frozen_inference", f"WITH {v.LOO} SELECT pert, gene, round(0.7 * ((pred - 0.0) / 0.05 * 1.2 + (control_mean - 0.5) / 0.2 * -0.1) + 0.3 * ((pred - 0.01) / 0.04 * 0.9), 5) AS pred FROM loo")
def frozen_inference(spark, sf_dir):
    """Standardise, weigh and blend by a coefficient table."""
    coef = spark.createDataFrame(COEF, "member string, weight double, column string, mean double, scale double, coef double")
    long = v.loo_mean(v.delta_view(spark, sf_dir)).select("pert", "gene", F.explode(F.create_map(F.lit("pred"), F.col("pred"), F.lit("control_mean"), F.col("control_mean"))).alias("column", "x"))
    term = F.col("weight") * (F.col("x") - F.col("mean")) / F.col("scale") * F.col("coef")
    return long.join(F.broadcast(coef), "column").groupBy("pert", "gene").agg(F.round(F.sum(term), 5).alias("pred"))  # three rows


@query("visible_reproduction", f"WITH {v.LOO}, s AS (SELECT pert, {v.sql_pearson('pred', 'delta')} AS r FROM loo GROUP BY 1) SELECT pert, abs(round(r, 3) - r) <= 0.002 AS reproduced FROM s")
def visible_reproduction(spark, sf_dir):
    """A stored score against the recomputed one."""
    s = v.loo_mean(v.delta_view(spark, sf_dir)).groupBy("pert").agg(stats.pearson(F.col("pred"), F.col("delta")).alias("r"))
    return s.select("pert", (F.abs(F.round("r", 3) - F.col("r")) <= 0.002).alias("reproduced"))


@query("feature_pool", "WITH g AS (SELECT user_id AS f, max(value) AS gain, min(event_id) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT f, first FROM g WHERE gain > 95 UNION SELECT user_id, min(event_id) FROM events WHERE user_id < 3 AND event_type = 'purchase' GROUP BY 1")
def feature_pool(spark, sf_dir):
    """Features of a gain, and the built-in ones, with the row that brought them in."""
    g = v.table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("f")).agg(F.max("value").alias("gain"), F.min("event_id").alias("first"))
    return g.where("gain > 95 or f < 3").select("f", "first")


@query("nested_memberships", "SELECT c_custkey, a AS outer_fold, b AS inner_fold, c_custkey % 5 <> a AND c_custkey % 3 <> b AS train FROM customer, (SELECT unnest(range(5))::INT AS a), (SELECT unnest(range(3))::INT AS b)")
def nested_memberships(spark, sf_dir):
    """L31."""
    folds = v.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("outer_fold")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("inner_fold"))
    return folds.withColumn("train", (F.col("c_custkey") % 5 != F.col("outer_fold")) & (F.col("c_custkey") % 3 != F.col("inner_fold")))


@query("fallback_prediction", f"WITH {v.LOO} SELECT pert, gene, round(coalesce(CASE WHEN pert % 3 > 0 THEN pred END, control_mean), 6) AS pred FROM loo")
def fallback_prediction(spark, sf_dir):
    """The mean where a model has no answer."""
    return v.loo_mean(v.delta_view(spark, sf_dir)).select("pert", "gene", v.r6(F.coalesce(F.when(F.col("pert") % 3 > 0, F.col("pred")), F.col("control_mean"))).alias("pred"))


@query("derivability")
def derivability(spark, sf_dir):
    """Is a column a transform of those the model has? Out of fold by group."""
    d = v.loo_mean(v.delta_view(spark, sf_dir)).select(F.col("pred"), F.col("control_mean"), (F.col("pert") % 5).alias("fold"), (F.col("pred") * F.col("control_mean")).alias("product"), F.col("delta"))
    rows = [(c, round(float(linear.derivability(d.select("pred", "control_mean", "fold", c), c, "fold")), 6)) for c in ("product", "delta")]  # two columns
    return spark.createDataFrame(rows, "column string, r2 double")


@query("low_rank_baseline")
def low_rank_baseline(spark, sf_dir):
    """Bilinear low-rank baseline on held-out groups."""
    from quillon.plans.features import context

    c = context(spark, sf_dir)
    return linear.low_rank(c.delta, c.targets, "pert % 5 >= 3")


@query("learned_pair_kernel")
def learned_pair_kernel(spark, sf_dir):
    """From pair features to the correlation of responses."""
    d = v.delta_view(spark, sf_dir)
    a = d.selectExpr("pert as a", "gene", "delta as x", "mean as ma")
    pairs = a.join(d.selectExpr("pert as b", "gene", "delta as y", "mean as mb"), "gene").where("a < b").groupBy("a", "b").agg(stats.pearson(F.col("x"), F.col("y")).alias("r"), F.avg(F.abs(F.col("ma") - F.col("mb"))).alias("gap"), F.avg(F.col("ma") * F.col("mb")).alias("product"))
    return linear.pair_kernel(pairs, ["gap", "product"], "r")


@query("compact_curve")
def compact_curve(spark, sf_dir):
    """L28."""
    return linear.compact_curve(linear.design(v.loo_mean(v.delta_view(spark, sf_dir))), "y", [0.1, 1.0, 10.0])


@query("nested_blend", f"WITH {v.LOO}, o AS (SELECT unnest(range(3))::INT AS fold), w AS (SELECT fold, sum((pred - control_mean / 100) * (delta - control_mean / 100)) / sum((pred - control_mean / 100) * (pred - control_mean / 100)) AS w FROM loo, o WHERE pert % 3 <> fold GROUP BY 1) SELECT fold, round(least(1.0, greatest(0.0, max(w))), 6) AS weight, round(avg(pow(delta - control_mean / 100 - least(1.0, greatest(0.0, w)) * (pred - control_mean / 100), 2)), 7) AS mse FROM loo JOIN w ON w.fold = pert % 3 GROUP BY 1")
def nested_blend(spark, sf_dir):
    """The blend weight is learned outside the fold that it is read on."""
    d = v.loo_mean(v.delta_view(spark, sf_dir)).withColumns({"e": F.col("pred") - F.col("control_mean") / 100, "y": F.col("delta") - F.col("control_mean") / 100})
    folds = d.select("pert", "e", "y", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold")).where("pert % 3 <> fold")
    w = folds.groupBy("fold").agg((F.sum(F.col("e") * F.col("y")) / F.sum(F.col("e") * F.col("e"))).alias("w")).select("fold", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w"))).alias("w"))
    gap = F.col("y") - F.col("w") * F.col("e")
    return d.withColumn("fold", (F.col("pert") % 3).cast("int")).join(w, "fold").groupBy("fold").agg(v.r6(F.max("w")).alias("weight"), F.round(F.avg(gap * gap), 7).alias("mse"))
