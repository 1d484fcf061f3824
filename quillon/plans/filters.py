"""Projections, filters and predicates (P rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import stats

from . import views as v
from .registry import query


@query("raw_count_predicate", "SELECT l_suppkey, bool_and(abs(l_quantity - round(l_quantity)) <= 1e-8 + 1e-5 * abs(round(l_quantity))) AND max(l_quantity) > 20 AS counts, bool_and(abs(l_tax - round(l_tax)) <= 1e-8 + 1e-5 * abs(round(l_tax))) AND max(l_tax) > 20 AS tax_counts FROM lineitem GROUP BY 1")
def raw_count_predicate(spark, sf_dir):
    """All values integral and the largest over 20."""
    integral = lambda c: F.bool_and(F.abs(c - F.round(c)) <= 1e-8 + 1e-5 * F.abs(F.round(c))) & (F.max(c) > 20)
    return v.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(integral(F.col("l_quantity")).alias("counts"), integral(F.col("l_tax")).alias("tax_counts"))


@query("library_normalise", f"WITH {v.NORM} SELECT cell, gene, round(x, 6) AS x FROM norm")
def library_normalise(spark, sf_dir):
    """P02."""
    return v.normalised(v.counts(spark, sf_dir)).select("cell", "gene", v.r6("x").alias("x"))


@query("control_label", "SELECT doc_id, lower(source) IN ('src0', 'src1', 'control', 'non-targeting') OR regexp_matches(lower(source), '^src_?1\\d*$') AS control FROM documents")
def control_label(spark, sf_dir):
    """A fixed set without case, or a pattern."""
    s = F.lower("source")
    return v.table(spark, sf_dir, "documents").select("doc_id", (s.isin("src0", "src1", "control", "non-targeting") | s.rlike(r"^src_?1\d*$")).alias("control"))


@query("suffix_token", "SELECT p_partkey, CASE WHEN p_name IN (SELECT p_type FROM part) THEN false WHEN regexp_matches(p_name, '(?i)^(sg|guide)?[a-z]*[ #_-]?\\d{1,3}$') THEN true ELSE regexp_matches(p_name, '\\d$') AND p_size > 25 END AS suffix FROM part")
def suffix_token(spark, sf_dir):
    """Guide-like tokens, unless they are real names."""
    part = v.table(spark, sf_dir, "part")
    real = part.select(F.col("p_type").alias("real")).distinct()
    name = F.col("p_name")
    kind = F.when(F.col("real").isNotNull(), False).when(name.rlike(r"(?i)^(sg|guide)?[a-z]*[ #_-]?\d{1,3}$"), True).otherwise(name.rlike(r"\d$") & (F.col("p_size") > 25))
    return part.join(real, name == F.col("real"), "left").select("p_partkey", kind.alias("suffix"))


@query("group_min_cells", f"WITH {v.COUNTS}, g AS (SELECT pert, count(DISTINCT cell) AS n FROM cells GROUP BY 1) SELECT pert, n, n >= 600 AS kept FROM g")
def group_min_cells(spark, sf_dir):
    """Small groups are rejected, with their counts."""
    return v.counts(spark, sf_dir).groupBy("pert").agg(F.count_distinct("cell").alias("n")).withColumn("kept", F.col("n") >= 600)


@query("set_size_filter", "SELECT l_orderkey AS name, count(DISTINCT l_partkey) AS size, array_to_string(list_slice(list_sort(list_distinct(list(l_partkey))), 1, 5), ',') AS head FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) BETWEEN 3 AND 500")
def set_size_filter(spark, sf_dir):
    """Sets of 3 to 500 measured members, distinct and sorted."""
    members = F.array_sort(F.collect_set("l_partkey"))
    g = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(members.alias("m"))
    return g.where(F.size("m").between(3, 500)).select("name", F.size("m").cast("long").alias("size"), F.array_join(F.slice("m", 1, 5).cast("array<string>"), ",").alias("head"))


@query("evidence_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND NOT list_contains(string_split(replace(props, '\"k\": 6', '|NOT|'), '|'), 'NOT')")
def evidence_filter(spark, sf_dir):
    """Allowed codes, without the NOT qualifier among the split qualifiers."""
    parts = F.split(F.replace("props", F.lit('"k": 6'), F.lit("|NOT|")), r"\|")
    return v.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase") & ~F.array_contains(parts, "NOT")).select("event_id")


@query(
    "channel_score_edges",
    "WITH e AS (SELECT least(l_partkey % 60, l_suppkey % 60) AS a, greatest(l_partkey % 60, l_suppkey % 60) AS b, round(1 - (1 - l_discount) * (1 - l_quantity / 100), 4) AS s FROM lineitem WHERE l_partkey % 60 <> l_suppkey % 60) SELECT a, b, max(s) AS s FROM e WHERE s >= 0.45 GROUP BY 1, 2",
)
def channel_score_edges(spark, sf_dir):
    """Channels combined, thresholded, one undirected edge with its largest score."""
    a, b = F.col("l_partkey") % 60, F.col("l_suppkey") % 60
    s = F.round(1 - (1 - F.col("l_discount")) * (1 - F.col("l_quantity") / 100), 4)
    e = v.table(spark, sf_dir, "lineitem").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), s.alias("s"))
    return e.where("s >= 0.45").groupBy("a", "b").agg(F.max("s").alias("s"))


@query(
    "signed_edges",
    "WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN -1.0::DOUBLE ELSE 1.0 END AS sign, l_orderkey * 10 + l_linenumber AS n FROM lineitem) SELECT a, b, arg_max(sign, n) AS sign FROM e GROUP BY 1, 2",
)
def signed_edges(spark, sf_dir):
    """-1 only for inhibition without stimulation; the last row of a pair wins."""
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "O"), -1.0).otherwise(1.0)
    return v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max_by(sign, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sign"))


@query("finite_guard", "SELECT event_type, count(*) FILTER (isnan(value) OR isinf(value) OR value IS NULL) AS bad FROM events GROUP BY 1")
def finite_guard(spark, sf_dir):
    """P10."""
    x = F.col("value")
    return v.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"))


@query("measured_mask", "SELECT p_brand, p_size, CASE WHEN count(*) FILTER (p_type <> 'PROMO') > 0 THEN round(avg(p_retailprice), 6) END AS x FROM part WHERE p_retailprice > 950 GROUP BY 1, 2")
def measured_mask(spark, sf_dir):
    """Unmeasured is NULL, never NaN."""
    part = v.table(spark, sf_dir, "part").where("p_retailprice > 950")
    return part.groupBy("p_brand", "p_size").agg(F.when(F.count_if(F.col("p_type") != "PROMO") > 0, v.r6(F.avg("p_retailprice"))).alias("x"))


@query("constant_columns", "SELECT p_size, stddev_pop(p_retailprice) <= 1e-12 * greatest(1, abs(avg(p_retailprice))) AS price_constant, stddev_pop(p_size) <= 1e-12 * greatest(1, abs(avg(p_size))) AS size_constant FROM part GROUP BY 1")
def constant_columns(spark, sf_dir):
    """P12."""
    flat = lambda c: F.stddev_pop(c) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.avg(c)))
    return v.table(spark, sf_dir, "part").groupBy("p_size").agg(flat("p_retailprice").alias("price_constant"), flat(F.col("p_size") * 1).alias("size_constant"))


@query("eligibility_reasons", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey = 0 THEN 'control' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer")
def eligibility_reasons(spark, sf_dir):
    """Every reason against a row; none means eligible."""
    reasons = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "debt"), F.when(F.col("c_nationkey") == 0, "control"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment")))
    return v.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(reasons, ",").alias("reasons"))


@query(
    "proportional_rows",
    "WITH s AS (SELECT l_orderkey AS r, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey AS r, sqrt(sum((l_extendedprice - c * l_quantity) * (l_extendedprice - c * l_quantity))) <= 1e-6 * sqrt(sum(l_extendedprice * l_extendedprice)) AS proportional FROM lineitem JOIN s ON r = l_orderkey GROUP BY 1",
)
def proportional_rows(spark, sf_dir):
    """Is a column a scalar times another, row by row, within a relative residual?"""
    line = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"))
    c = F.sum(F.col("q") * F.col("x")).over(Window.partitionBy("r")) / F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("r"))
    gap = F.col("x") - F.col("c") * F.col("q")
    return line.withColumn("c", c).groupBy("r").agg((F.sqrt(F.sum(gap * gap)) <= 1e-6 * F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("proportional"))


@query("label_dependence", f"WITH {v.DELTA}, f AS (SELECT gene, avg(delta) AS fold FROM delta WHERE pert % 5 <> 0 GROUP BY 1), w AS (SELECT gene, avg(delta) AS whole FROM delta GROUP BY 1) SELECT gene, abs(fold - whole) > 1e-12 AS dependent FROM f JOIN w USING (gene)")
def label_dependence(spark, sf_dir):
    """A fold's block differs from the full one."""
    d = v.delta_view(spark, sf_dir)
    return d.groupBy("gene").agg((F.abs(F.avg(F.when(F.col("pert") % 5 != 0, F.col("delta"))) - F.avg("delta")) > 1e-12).alias("dependent"))


@query("expressed_stratum", f"WITH {v.COUNTS}, n AS (SELECT count(DISTINCT cell) AS n FROM cells WHERE pert = 0) SELECT gene, CASE WHEN count(*) FILTER (cnt > 0)::DOUBLE / max(n) >= 0.05 THEN 'expressed' ELSE 'silent' END AS stratum FROM cells, n WHERE pert = 0 GROUP BY 1")
def expressed_stratum(spark, sf_dir):
    """Non-zero in at least 5 % of the control cells."""
    c = v.counts(spark, sf_dir).where("pert = 0")
    n = c.agg(F.count_distinct("cell").alias("n"))
    share = F.count_if(F.col("cnt") > 0) / F.max("n")
    return c.crossJoin(F.broadcast(n)).groupBy("gene").agg(F.when(share >= 0.05, "expressed").otherwise("silent").alias("stratum"))  # one row


@query("source_reads", "WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: x IN ('the', 'and', 'der', 'los')) AS f FROM documents) SELECT doc_id, len(f)::BIGINT AS reads, array_to_string(list_sort(list_distinct(f)), ',') AS names FROM w")
def source_reads(spark, sf_dir):
    """Which inputs a text names."""
    found = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: x.isin("the", "and", "der", "los"))
    return v.table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("reads"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("names"))


@query("unread_mentions", "SELECT item_id, w AS word, contains(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' ' || w || ' ') AS mentioned FROM benchmark CROSS JOIN (VALUES ('the'), ('of'), ('und'), ('que')) AS t(w)")
def unread_mentions(spark, sf_dir):
    """Which texts name which inputs, by word bounds (a fixed short list of inputs)."""
    words = F.explode(F.array(*(F.lit(w) for w in ("the", "of", "und", "que"))))
    return v.table(spark, sf_dir, "benchmark").select("item_id", "text", words.alias("word")).select("item_id", "word", F.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z]+", " "), F.lit(" ")), F.concat(F.lit(" "), "word", F.lit(" "))).alias("mentioned"))


@query("spec_violations", "SELECT o_orderkey, len(list_filter([o_totalprice < 1000, o_orderpriority LIKE '5%', o_custkey % 3 = 0], lambda x: x))::INT AS flags, o_totalprice < 1000 OR o_custkey % 3 = 0 AS rejected FROM orders")
def spec_violations(spark, sf_dir):
    """Hard rejections and soft flags of a specification."""
    rules = F.array(F.col("o_totalprice") < 1000, F.col("o_orderpriority").like("5%"), F.col("o_custkey") % 3 == 0)
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.filter(rules, lambda x: x)).alias("flags"), ((F.col("o_totalprice") < 1000) | (F.col("o_custkey") % 3 == 0)).alias("rejected"))


@query("sign_dead_zone", f"WITH {v.DELTA} SELECT pert, gene, CASE WHEN delta >= 0.05 THEN 'up' WHEN delta <= -0.05 THEN 'down' ELSE 'none' END AS sign FROM delta")
def sign_dead_zone(spark, sf_dir):
    """P20."""
    d = F.col("delta")
    return v.delta_view(spark, sf_dir).select("pert", "gene", F.when(d >= 0.05, "up").when(d <= -0.05, "down").otherwise("none").alias("sign"))


@query("candidate_validation", "WITH c AS (SELECT c_custkey % 900 AS t, c_mktsegment AS s FROM customer), d AS (SELECT t, count(*) AS n FROM c GROUP BY 1) SELECT t, n > 1 AS repeated, t NOT IN (SELECT o_custkey FROM orders) AS outside FROM d")
def candidate_validation(spark, sf_dir):
    """Repeated candidates and those outside the universe."""
    c = v.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 900).alias("t")).agg(F.count("*").alias("n"))
    known = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t")).distinct().withColumn("in", F.lit(True))
    return c.join(known, "t", "left").select("t", (F.col("n") > 1).alias("repeated"), F.col("in").isNull().alias("outside"))


@query("usable_targets", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: abs(x) > 0.1)) >= 3 AND label > 2")
def usable_targets(spark, sf_dir):
    """Vectors of the right length with at least three measured values."""
    return v.table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & (F.size(F.filter("embedding", lambda x: F.abs(x) > F.lit(0.1).cast("double"))) >= 3) & (F.col("label") > 2)).select("vec_id")


@query("noise_ceiling_filter", f"WITH {v.DELTA} SELECT pert, round({v.sql_pearson('mean', 'control_mean')}, 6) AS r FROM delta GROUP BY 1 HAVING count(*) >= 3")
def noise_ceiling_filter(spark, sf_dir):
    """P23 stand-in: groups with enough shared measures, with their correlation to the control."""
    g = v.delta_view(spark, sf_dir).groupBy("pert").agg(F.count("*").alias("n"), stats.pearson(F.col("mean"), F.col("control_mean")).alias("r"))
    return g.where("n >= 3").select("pert", v.r6("r").alias("r"))
