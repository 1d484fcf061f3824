"""Joins: strict, outer, priority lookups, all-or-nothing, similarity, range and recursive joins (J rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators.graph import chain_ends, chain_root
from quillon.operators.joins import interval_neighbours, jaccard_of_members, nearest_lists, priority_lookup, strict_one_to_one

from . import views as v
from .registry import query

LABELS = "(VALUES ('a', 'Brand#11'), ('b', 'brand#12'), ('c', 'B13'), ('d', 'b14'), ('e', 'none')) AS l(label, raw)"


@query("prediction_truth_join", f"WITH {v.LOO} SELECT l.pert, l.gene, round(l.pred, 6) AS pred, round(l.delta, 6) AS truth, r.rk AS de_rank FROM loo l LEFT JOIN (SELECT pert, gene, row_number() OVER (PARTITION BY pert ORDER BY abs(delta) DESC, gene) AS rk FROM delta) r ON r.pert = l.pert AND r.gene = l.gene AND r.rk <= 5")
def prediction_truth_join(spark, sf_dir):
    """Predictions with truth and, where there is one, the reference rank."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("pert").orderBy(F.abs("delta").desc(), "gene"))
    ref = loo.select("pert", "gene", rank.cast("long").alias("de_rank")).where("de_rank <= 5")
    return loo.join(ref, ["pert", "gene"], "left").select("pert", "gene", v.r6("pred").alias("pred"), v.r6("delta").alias("truth"), "de_rank")


@query("strict_join", "SELECT n_nationkey AS key, n_name AS a, count(c_custkey) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def strict_join(spark, sf_dir):
    """Both sides must have the same keys, once each; otherwise the query fails."""
    left = v.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("a"))
    right = v.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("c_custkey").alias("b"))
    return strict_one_to_one(left, right, "key")


@query("left_join_fill", "SELECT g.p_brand AS gene, count(CASE WHEN p.p_size = 50 THEN 1 END) AS n, max(CASE WHEN p.p_size = 50 AND p.p_type = 'PROMO' THEN p_retailprice END) AS measured FROM (SELECT DISTINCT p_brand FROM part) g LEFT JOIN part p ON p.p_brand = g.p_brand GROUP BY 1")
def left_join_fill(spark, sf_dir):
    """Every measure stays; NULL where the other table has none."""
    part = v.table(spark, sf_dir, "part")
    other = part.where("p_size = 50").groupBy("p_brand").agg(F.count("*").alias("n"), F.max(F.when(F.col("p_type") == "PROMO", F.col("p_retailprice"))).alias("measured"))
    return part.select("p_brand").distinct().join(other, "p_brand", "left").select(F.col("p_brand").alias("gene"), F.coalesce("n", F.lit(0)).alias("n"), "measured")


@query(
    "priority_lookup",
    f"""WITH g AS (SELECT p_brand AS name, min(p_partkey) AS col FROM part GROUP BY 1),
a(alias, name) AS (VALUES ('B13', 'Brand#13'), ('B14', 'Brand#14'), ('B13', 'Brand#15'))
SELECT l.label, coalesce((SELECT min(col) FROM g WHERE g.name = l.raw), (SELECT min(col) FROM a JOIN g USING (name) WHERE a.alias = l.raw), (SELECT min(col) FROM g WHERE lower(g.name) = lower(l.raw)),
(SELECT min(col) FROM a JOIN g USING (name) WHERE lower(a.alias) = lower(l.raw))) AS col FROM {LABELS}""",
)
def priority_lookup_query(spark, sf_dir):
    """Exact name, alias, then both without case; the first column wins."""
    names = v.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("col"))
    aliases = spark.createDataFrame([("B13", "Brand#13"), ("B14", "Brand#14"), ("B13", "Brand#15")], "alias string, name string")
    labels = spark.createDataFrame([("a", "Brand#11"), ("b", "brand#12"), ("c", "B13"), ("d", "b14"), ("e", "none")], "label string, raw string")
    return priority_lookup(labels, names, aliases).select("label", "col")


@query(
    "match_labels",
    """WITH l AS (SELECT doc_id, regexp_split_to_array(lower(text), '[+_|,;\\s]+') AS toks FROM documents),
t AS (SELECT doc_id, unnest(list_distinct(toks)) AS tok FROM l), g AS (SELECT DISTINCT tok FROM t WHERE length(tok) = 4)
SELECT l.doc_id, CASE WHEN list_contains(toks, 'the') THEN 'control' WHEN coalesce(n, 0) = 0 THEN 'other' WHEN n = 1 THEN 'single' ELSE 'multi' END AS kind, coalesce(n, 0)::BIGINT AS n
FROM l LEFT JOIN (SELECT doc_id, count(*) AS n FROM t JOIN g USING (tok) GROUP BY 1) c USING (doc_id)""",
)
def match_labels(spark, sf_dir):
    """Labels resolved by their tokens to control, single, multi or other."""
    toks = F.split(F.lower("text"), r"[+_|,;\s]+")
    rows = v.table(spark, sf_dir, "documents").select("doc_id", toks.alias("toks"))
    n = F.size(F.filter(F.array_distinct("toks"), lambda t: F.length(t) == 4))
    kind = F.when(F.array_contains("toks", "the"), "control").when(n == 0, "other").when(n == 1, "single").otherwise("multi")
    return rows.select("doc_id", kind.alias("kind"), n.cast("long").alias("n"))


@query("anti_join_train", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_train(spark, sf_dir):
    """J06."""
    return v.table(spark, sf_dir, "customer").join(v.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("semi_join_labels", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_labels(spark, sf_dir):
    """J07."""
    return v.table(spark, sf_dir, "documents").join(v.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query(
    "jaccard_pairs",
    """WITH m AS (SELECT DISTINCT s_nationkey AS a, l_partkey AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
s AS (SELECT a, count(*) AS n FROM m GROUP BY 1), i AS (SELECT p.a, q.a AS b, count(*) AS k FROM m p JOIN m q ON p.x = q.x AND p.a < q.a GROUP BY 1, 2)
SELECT i.a, i.b, round(k::DOUBLE / (s.n + t.n - k), 6) AS jaccard FROM i JOIN s ON s.a = i.a JOIN s t ON t.a = i.b""",
)
def jaccard_pairs(spark, sf_dir):
    """Jaccard similarity of member sets, through shared members (pairs without one are 0 and left out)."""
    m = v.table(spark, sf_dir, "lineitem").join(v.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("a"), F.col("l_partkey").alias("x")).distinct()
    return jaccard_of_members(m, "a", "x").select("a", "b", v.r6("jaccard").alias("jaccard"))


@query(
    "pairwise_corr",
    f"""WITH {v.DELTA} SELECT a.pert AS a, b.pert AS b, round(CASE WHEN count(*) >= 3 THEN {v.sql_pearson('a.delta', 'b.delta')} ELSE 0.0 END, 6) AS r FROM delta a JOIN delta b ON a.gene = b.gene AND a.pert < b.pert GROUP BY 1, 2""",
)
def pairwise_corr(spark, sf_dir):
    """Correlation of groups over the measures both have; 0 below three."""
    from quillon.operators.linear import group_correlations

    pairs = group_correlations(v.delta_view(spark, sf_dir)).where("p < q and n > 0")
    return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), v.r6(F.when(F.col("n") >= 3, F.col("r")).otherwise(0.0)).alias("r"))


@query("loo_exclude", f"WITH {v.LOO} SELECT pert, gene, round(pred, 6) AS pred FROM loo")
def loo_exclude(spark, sf_dir):
    """All rows but one's own, by sums over the window instead of a theta join."""
    return v.loo_mean(v.delta_view(spark, sf_dir)).select("pert", "gene", v.r6("pred").alias("pred"))


@query("hide_rule", "SELECT s.l_orderkey AS pert, f.fold FROM (SELECT DISTINCT l_orderkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(5))::INT AS fold) f WHERE NOT EXISTS (SELECT 1 FROM lineitem h WHERE h.l_orderkey = s.l_orderkey AND h.l_partkey % 5 = f.fold)")
def hide_rule(spark, sf_dir):
    """Per fold, the groups none of whose targets the fold hides."""
    line = v.table(spark, sf_dir, "lineitem")
    folds = line.select(F.col("l_orderkey").alias("pert")).distinct().select("pert", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    hidden = line.select(F.col("l_orderkey").alias("pert"), (F.col("l_partkey") % 5).cast("int").alias("fold")).distinct()
    return folds.join(hidden, ["pert", "fold"], "left_anti")


@query(
    "all_or_nothing_sum",
    """WITH t AS (SELECT l_orderkey AS pert, l_partkey AS target FROM lineitem),
e AS (SELECT p_partkey AS target, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END AS delta, p_size AS cells FROM part WHERE p_size > 5)
SELECT pert, round(CASE WHEN count(*) FILTER (e.delta IS NULL) = 0 THEN sum(e.delta) END, 4) AS delta, min(e.cells) AS cells FROM t LEFT JOIN e USING (target) GROUP BY pert HAVING count(e.target) = count(*)""",
)
def all_or_nothing_sum(spark, sf_dir):
    """A group only if every target has a row; a NULL part makes the sum NULL."""
    t = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pert"), F.col("l_partkey").alias("target"))
    e = v.table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("target"), F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("delta"), F.col("p_size").alias("cells"), F.lit(1).alias("there"))
    g = t.join(e, "target", "left").groupBy("pert").agg(F.count("there").alias("have"), F.count("*").alias("n"), F.count("delta").alias("known"), F.sum("delta").alias("s"), F.min("cells").alias("cells"))
    return g.where("have = n").select("pert", F.round(F.when(F.col("known") == F.col("n"), F.col("s")), 4).alias("delta"), "cells")


@query(
    "interval_neighbours",
    """WITH e AS (SELECT event_id AS id, user_id AS chrom, floor(epoch(ts))::BIGINT AS pos, length(event_type) % 2 AS strand FROM events)
SELECT a.id, count(b.id) AS near, count(b.id) FILTER (b.strand <> a.strand AND abs(a.pos - b.pos) <= 14400) AS opposite, min(abs(a.pos - b.pos)) AS nearest FROM e a LEFT JOIN e b ON a.chrom = b.chrom AND a.id <> b.id AND abs(a.pos - b.pos) <= 86400 GROUP BY 1""",
)
def interval_neighbours_query(spark, sf_dir):
    """Neighbours within a distance, by binned positions; opposite strand close by; the nearest."""
    e = v.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), F.unix_timestamp("ts").alias("pos"), (F.length("event_type") % 2).alias("strand"))
    return interval_neighbours(e, 86400, 14400)


@query(
    "nearest_neighbours",
    """WITH e AS (SELECT event_id AS id, user_id AS chrom, floor(epoch(ts))::BIGINT AS pos FROM events), g AS (SELECT a.id, b.id AS other, abs(a.pos - b.pos) AS gap FROM e a JOIN e b ON a.chrom = b.chrom AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS n FROM g)
SELECT e.id, min(gap) AS nearest, coalesce(string_agg(other::VARCHAR, ',' ORDER BY gap, other) FILTER (n <= 20 AND gap <= 86400), '') AS list FROM e LEFT JOIN r USING (id) GROUP BY e.id""",
)
def nearest_neighbours(spark, sf_dir):
    """The nearest other point however far, and up to 20 within a distance, in order."""
    e = v.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), F.unix_timestamp("ts").alias("pos"))
    return nearest_lists(e, 86400).select("id", "nearest", F.array_join("list", ",").alias("list"))


@query("two_sided_lookup", "SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY 1, 2")
def two_sided_lookup(spark, sf_dir):
    """Names on both ends of an edge."""
    nation = v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # a fixed dimension
    line = v.table(spark, sf_dir, "lineitem").join(v.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = line.join(v.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = both.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    return edges.join(nation.selectExpr("n_nationkey as s_nationkey", "n_name as src"), "s_nationkey").join(nation.selectExpr("n_nationkey as c_nationkey", "n_name as dst"), "c_nationkey").select("src", "dst", "n")


@query("overlap_pairs", "SELECT DISTINCT a.l_orderkey AS p, b.l_orderkey AS q FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey")
def overlap_pairs(spark, sf_dir):
    """Groups that share a target, through the targets."""
    t = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return t.selectExpr("l_orderkey as p", "l_partkey").join(t.selectExpr("l_orderkey as q", "l_partkey"), "l_partkey").where("p < q").select("p", "q").distinct()


@query(
    "lineage_recursive",
    """WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey < 8 THEN NULL ELSE o_orderkey // 2 END AS parent FROM orders),
w AS (SELECT id, id AS node, parent, 0 AS depth FROM t UNION ALL SELECT w.id, t.id, t.parent, depth + 1 FROM w JOIN t ON t.id = w.parent)
SELECT id, max(depth)::BIGINT AS depth, arg_max(node, depth) AS root FROM w GROUP BY 1""",
)
def lineage_recursive(spark, sf_dir):
    """Depth and root of the parent chain of every row, by pointer doubling."""
    t = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("case when o_orderkey % 7 = 0 or o_orderkey < 8 then null else o_orderkey div 2 end").alias("parent"))
    return chain_ends(t, "id", "parent")


@query(
    "duplicate_chain",
    """WITH RECURSIVE t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN doc_id - 3 WHEN doc_id % 5 = 0 AND doc_id > 0 THEN doc_id - 1 END AS dup FROM documents),
w AS (SELECT id, id AS node, dup, 0 AS d FROM t UNION ALL SELECT w.id, t.id, t.dup, d + 1 FROM w JOIN t ON t.id = w.dup) SELECT id, arg_max(node, d) AS origin FROM w GROUP BY 1""",
)
def duplicate_chain(spark, sf_dir):
    """Follow duplicate-of links to the record itself, by pointer doubling."""
    d = F.col("doc_id")
    t = v.table(spark, sf_dir, "documents").select(d.alias("id"), F.when((d % 3 == 0) & (d > 0), d - 3).when((d % 5 == 0) & (d > 0), d - 1).alias("dup"))
    return chain_root(t, "id", "dup").select("id", F.col("root").alias("origin"))


@query(
    "paired_join",
    """WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (x > y) AS wins, count(*) FILTER (x = y) AS ties, round(avg(x - y), 4) AS gain FROM a JOIN b USING (k)""",
)
def paired_join(spark, sf_dir):
    """Comparison on common keys, with ties."""
    o = v.table(spark, sf_dir, "orders")
    side = lambda status, name: o.where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.avg("o_totalprice").alias(name))
    return side("F", "x").join(side("O", "y"), "o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.round(F.avg(F.col("x") - F.col("y")), 4).alias("gain"))


@query(
    "run_alignment",
    """WITH r AS (SELECT user_id AS k, event_type AS tier, avg(value) AS s FROM events GROUP BY 1, 2)
SELECT a.k, round(a.s, 6) AS visible, round(CASE WHEN b.s IS NOT NULL AND c.s IS NOT NULL THEN (b.s + c.s) / 2 END, 6) AS oof FROM r a LEFT JOIN r b ON b.k = a.k AND b.tier = 'click' LEFT JOIN r c ON c.k = a.k AND c.tier = 'error' WHERE a.tier = 'view'""",
)
def run_alignment(spark, sf_dir):
    """Alignment by key and tier; the second score only when both sides have it."""
    r = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(*(F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in ("view", "click", "error")))
    return r.where("view is not null").select("k", v.r6("view").alias("visible"), v.r6((F.col("click") + F.col("error")) / 2).alias("oof"))


@query(
    "one_to_one_mapping",
    "WITH m AS (SELECT DISTINCT c_mktsegment AS old, 'S' || (CASE WHEN c_mktsegment > 'F' THEN c_nationkey % 2 ELSE 0 END + length(c_mktsegment)) AS new FROM customer), u AS (SELECT old, min(new) AS new, count(*) AS n FROM m GROUP BY 1) SELECT c_custkey, CASE WHEN n = 1 THEN new END AS symbol FROM customer LEFT JOIN u ON u.old = c_mktsegment",
)
def one_to_one_mapping(spark, sf_dir):
    """A mapping is used only where it is not one to many."""
    c = v.table(spark, sf_dir, "customer")
    new = F.concat(F.lit("S"), (F.when(F.col("c_mktsegment") > "F", F.col("c_nationkey") % 2).otherwise(0) + F.length("c_mktsegment")).cast("string"))
    u = c.groupBy("c_mktsegment").agg(F.min(new).alias("to"), F.max(new).alias("last")).where("to = last")
    return c.join(u, "c_mktsegment", "left").select("c_custkey", F.col("to").alias("symbol"))


@query("pick_longest", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def pick_longest(spark, sf_dir):
    """One row per name, the longest, ties by id."""
    return v.table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by(F.struct("doc_id", "n_chars"), F.struct(-F.col("n_chars"), "doc_id")).alias("b")).select("source", "b.doc_id", "b.n_chars")


@query(
    "seen_singles",
    "WITH s AS (SELECT l_partkey AS t FROM lineitem GROUP BY l_orderkey, l_partkey HAVING l_orderkey % 5 = 0), k AS (SELECT DISTINCT t FROM s) SELECT l_orderkey AS pert, 'seen' || count(DISTINCT CASE WHEN k.t IS NOT NULL THEN l_partkey END) AS category FROM lineitem LEFT JOIN k ON k.t = l_partkey WHERE l_orderkey % 5 = 1 GROUP BY 1",
)
def seen_singles(spark, sf_dir):
    """How many targets of a group were seen in training."""
    line = v.table(spark, sf_dir, "lineitem")
    seen = line.where("l_orderkey % 5 = 0").select("l_partkey").distinct().withColumn("seen", F.lit(1))
    own = line.where("l_orderkey % 5 = 1").select(F.col("l_orderkey").alias("pert"), "l_partkey").distinct()
    return own.join(seen, "l_partkey", "left").groupBy("pert").agg(F.concat(F.lit("seen"), F.count("seen").cast("string")).alias("category"))


@query("ensemble_average", f"WITH {v.LOO}, m AS (SELECT pert, gene, pred FROM loo UNION ALL SELECT pert, gene, 0.0 FROM loo UNION ALL SELECT pert, gene, control_mean / 10 FROM loo) SELECT pert, gene, round(avg(pred), 6) AS pred, count(*) AS members FROM m GROUP BY 1, 2 HAVING count(*) = 3")
def ensemble_average(spark, sf_dir):
    """Predictions of several runs averaged; the same groups in each."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    parts = [loo.select("pert", "gene", c.alias("pred")) for c in (F.col("pred"), F.lit(0.0), F.col("control_mean") / 10)]
    union: DataFrame = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return union.groupBy("pert", "gene").agg(v.r6(F.avg("pred")).alias("pred"), F.count("*").alias("members")).where("members = 3")


@query(
    "external_split_map",
    "SELECT o_custkey AS key, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END)::INT AS rank FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def external_split_map(spark, sf_dir):
    """The most held-out set of a key wins; controls are ignored."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return v.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("key")).agg(F.max(rank).alias("rank"))


@query(
    "coverage_join",
    """SELECT p_partkey AS target, coalesce(a.n, 0) AS sales, coalesce(b.n, 0) AS returns, coalesce(a.n, 0) = 0 AS unannotated FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_partkey = p_partkey""",
)
def coverage_join(spark, sf_dir):
    """Counts of what is known of each target, one aggregation, one join."""
    known = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.count("*").alias("sales"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")).join(known, "target", "left").select("target", zero("sales").alias("sales"), zero("returns").alias("returns"), (zero("sales") == 0).alias("unannotated"))
