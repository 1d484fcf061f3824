"""Ordered accumulations and ranks (W rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators.numbering import hash_ranks, numbered, row_ranks, value_ranks

from . import views as v
from .registry import query

#: p values of the tests below: one a customer segment and nation, made from sums by arithmetic both engines share.
PVALUES = "pv AS (SELECT c_mktsegment AS fam, c_nationkey AS id, (sum(c_custkey)::BIGINT % 997 + 1) / 1000.0::DOUBLE AS p FROM customer GROUP BY 1, 2)"


def p_values(spark, sf_dir):
    return v.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("fam"), F.col("c_nationkey").alias("id")).agg(((F.sum("c_custkey") % 997 + 1) / F.lit(1000.0)).alias("p"))


@query("rank_marks", "WITH m AS (SELECT l_suppkey AS arm, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1), u AS (SELECT arm, 'a' AS metric, -a AS s FROM m UNION ALL SELECT arm, 'b', b FROM m) SELECT metric, arm, r FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(s, 9), arm) AS r FROM u) WHERE r <= 3")
def rank_marks(spark, sf_dir):
    """Top three per metric; the second metric is better when lower."""
    m = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("arm")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))
    u = m.select("arm", F.explode(F.create_map(F.lit("a"), -F.col("a"), F.lit("b"), F.col("b"))).alias("metric", "s"))
    return u.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.round("s", 9), "arm")).cast("long")).where("r <= 3").select("metric", "arm", "r")


@query("bh_adjust", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS n FROM pv) SELECT fam, id, round(p, 6) AS p, round(least(1.0, min(p * n / rk) OVER (PARTITION BY fam ORDER BY rk DESC)), 6) AS padj FROM r")
def bh_adjust(spark, sf_dir):
    """Benjamini-Hochberg within families."""
    w = Window.partitionBy("fam")
    r = p_values(spark, sf_dir).withColumns({"rk": F.row_number().over(w.orderBy("p", "id")), "n": F.count("*").over(w)})
    return r.select("fam", "id", v.r6("p").alias("p"), v.r6(stats.benjamini_hochberg(F.col("p"), F.col("rk"), F.col("n"), w.orderBy(F.desc("rk")))).alias("padj"))


@query("holm_adjust", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS rk, count(*) OVER (PARTITION BY fam) AS n FROM pv) SELECT fam, id, round(max(least(1.0, (n - rk + 1) * p)) OVER (PARTITION BY fam ORDER BY rk), 6) AS padj FROM r")
def holm_adjust(spark, sf_dir):
    """Holm within families."""
    w = Window.partitionBy("fam")
    r = p_values(spark, sf_dir).withColumns({"rk": F.row_number().over(w.orderBy("p", "id")), "n": F.count("*").over(w)})
    return r.select("fam", "id", v.r6(stats.holm(F.col("p"), F.col("rk"), F.col("n"), w.orderBy("rk"))).alias("padj"))


REPLICATES = "obs AS (SELECT p_brand AS f, avg(p_retailprice) AS o FROM part GROUP BY 1), rep AS (SELECT f, b, o * (0.5 + ((ascii(substr(f, 7, 1)) * 31 + ascii(substr(f, 8, 1)) * 17 + b * 7919) % 1000) / 1000.0::DOUBLE) AS g FROM obs CROSS JOIN (SELECT unnest(range(40))::BIGINT AS b))"


@query(
    "max_gain_stepdown",
    f"""WITH {REPLICATES}, s AS (SELECT r.f, r.b, max(r2.g) AS top FROM rep r JOIN obs x ON x.f = r.f JOIN rep r2 ON r2.b = r.b JOIN obs y ON y.f = r2.f AND (y.o < x.o OR y.o = x.o AND y.f >= x.f) GROUP BY 1, 2),
c AS (SELECT s.f, any_value(o) AS o, (1 + count(*) FILTER (top >= o)) / 41.0::DOUBLE AS p FROM s JOIN obs USING (f) GROUP BY 1)
SELECT f, round(max(p) OVER (ORDER BY o DESC, f), 6) AS padj FROM c""",
)
def max_gain_stepdown(spark, sf_dir):
    """Step-down maxima over shared replicates: a member is held against the best of those not above it."""
    obs = v.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("f")).agg(F.avg("p_retailprice").alias("o"))
    code = F.ascii(F.substring("f", 7, 1)) * 31 + F.ascii(F.substring("f", 8, 1)) * 17
    rep = obs.select("f", "o", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b")).withColumn("g", F.col("o") * (0.5 + (code + F.col("b") * 7919) % 1000 / F.lit(1000.0)))
    # From the smallest observation up: the running maximum of the replicate.
    s = rep.withColumn("top", F.max("g").over(Window.partitionBy("b").orderBy("o", F.desc("f"))))
    c = s.groupBy("f").agg(F.first("o").alias("o"), ((1 + F.count_if(F.col("top") >= F.col("o"))) / F.lit(41.0)).alias("p"))
    return c.select("f", v.r6(F.max("p").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("o"), "f"))).alias("padj"))


@query(
    "running_best",
    "WITH b AS (SELECT event_type, event_id, ts, value, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS best, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT event_type, event_id, round(best, 6) AS best FROM b WHERE before IS NULL OR value > before",
)
def running_best(spark, sf_dir):
    """The improvements of the best value, in order of completion."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    b = v.table(spark, sf_dir, "events").withColumns({"best": F.max("value").over(w), "before": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return b.where("before is null or value > before").select("event_type", "event_id", v.r6("best").alias("best"))


@query(
    "max_concurrency",
    "WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS t, 1 AS d FROM events UNION ALL SELECT event_type, floor(epoch(ts))::BIGINT + (value * 60)::BIGINT + 1, -1 FROM events), s AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT event_type, max(n)::BIGINT AS most FROM s GROUP BY 1",
)
def max_concurrency(spark, sf_dir):
    """Most intervals open at once; at equal times an end comes before a start."""
    t = F.unix_timestamp("ts")
    e = v.table(spark, sf_dir, "events").select("event_type", F.explode(F.array(F.struct(t.alias("t"), F.lit(1).alias("d")), F.struct((t + F.round(F.col("value") * 60).cast("long") + 1).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    s = e.select("event_type", F.sum("e.d").over(Window.partitionBy("event_type").orderBy("e.t", "e.d").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return s.groupBy("event_type").agg(F.max("n").alias("most"))


@query(
    "dry_rounds",
    "WITH r AS (SELECT user_id, event_id, ts, value > 60 AS novel FROM events), i AS (SELECT *, sum(CASE WHEN novel THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r), k AS (SELECT *, sum(CASE WHEN novel THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i) SELECT user_id, max(run)::BIGINT AS longest, bool_or(run >= 5) AS dry FROM k GROUP BY 1",
)
def dry_rounds(spark, sf_dir):
    """Consecutive rounds without novelty; a novel one resets the count."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = v.table(spark, sf_dir, "events").withColumn("novel", F.col("value") > 60).withColumn("island", F.sum(F.col("novel").cast("int")).over(w))
    k = i.withColumn("run", F.sum((~F.col("novel")).cast("int")).over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id")))
    return k.groupBy("user_id").agg(F.max("run").alias("longest"), F.bool_or(F.col("run") >= 5).alias("dry"))


@query("deciles", "SELECT p_partkey, p_brand, (10 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) // count(*) OVER (PARTITION BY p_brand))::BIGINT AS decile FROM part")
def deciles(spark, sf_dir):
    """floor(10 rank / n), ties by id."""
    part = v.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    sizes = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return row_ranks(part, ["p_brand"], "p_retailprice", "p_partkey", "k").join(sizes, "p_brand").select("p_partkey", "p_brand", F.floor(10 * (F.col("k") - 1) / F.col("n")).alias("decile"))


@query("first_seen", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_seen(spark, sf_dir):
    """The best row of each key, first seen on ties."""
    best = F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return v.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(best.alias("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("next_id", "WITH m AS (SELECT max(substr(c_name, 10)::BIGINT) AS top FROM customer) SELECT s_suppkey, 'EXP_' || lpad((top + row_number() OVER (ORDER BY s_suppkey))::VARCHAR, 6, '0') AS id FROM supplier, m WHERE s_acctbal < 0")
def next_id(spark, sf_dir):
    """Sequential ids after the largest one in use."""
    top = v.table(spark, sf_dir, "customer").agg(F.max(F.substring("c_name", 10, 20).cast("long")).alias("top"))
    new = v.table(spark, sf_dir, "supplier").where("s_acctbal < 0").crossJoin(F.broadcast(top))  # one row
    new = numbered(new, "s_suppkey", "k")
    n = F.col("top") + F.col("k")
    return new.select("s_suppkey", F.concat(F.lit("EXP_"), F.lpad(n.cast("string"), 6, "0")).alias("id"))


@query(
    "hash_draw",
    "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY sha256('7' || chr(10) || p_partkey)) AS rk FROM part) SELECT p_partkey, p_type, rk, CASE WHEN rk % 2 = 1 THEN 'R1' ELSE 'R2' END AS arm FROM r WHERE rk <= 40",
)
def hash_draw(spark, sf_dir):
    """Rank by the hash of seed and key, alternate ranks to two arms within strata."""
    order = F.sha2(F.concat_ws("\n", F.lit("7"), F.col("p_partkey").cast("string")), 256)
    part = v.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return hash_ranks(part, ["p_type"], order, "rk").where("rk <= 40").withColumn("arm", F.when(F.col("rk") % 2 == 1, "R1").otherwise("R2"))


@query("mid_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size)::DOUBLE + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS mid FROM part")
def mid_ranks(spark, sf_dir):
    """Average ranks."""
    part = v.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return part.join(value_ranks(part, ["p_type"], "p_size"), ["p_type", "p_size"]).select("p_partkey", "mid")


@query("sliding_failures", "SELECT event_id, count(*) FILTER (value < 20) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS failures FROM events")
def sliding_failures(spark, sf_dir):
    """Failures of the last two hours, by a range frame."""
    w = Window.partitionBy("user_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-7200, 0)
    return v.table(spark, sf_dir, "events").select("event_id", F.count_if(F.col("value") < 20).over(w).alias("failures"))


@query("cumulative_share", "WITH s AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal * c_acctbal) AS e FROM customer GROUP BY 1, 2) SELECT c_mktsegment, c_nationkey, round(sum(e) OVER (PARTITION BY c_mktsegment ORDER BY e DESC, c_nationkey) / sum(e) OVER (PARTITION BY c_mktsegment), 6) AS share FROM s")
def cumulative_share(spark, sf_dir):
    """Cumulative share of components, largest first."""
    w = Window.partitionBy("c_mktsegment")
    s = v.table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum(F.col("c_acctbal") * F.col("c_acctbal")).alias("e"))
    return s.select("c_mktsegment", "c_nationkey", v.r6(F.sum("e").over(w.orderBy(F.desc("e"), "c_nationkey")) / F.sum("e").over(w)).alias("share"))


@query("paced_budget", "SELECT event_id, round(1000 * least(1.0, (epoch(ts) - min(epoch(ts)) OVER () + 900) / 2592000.0::DOUBLE), 6) AS allowed FROM events")
def paced_budget(spark, sf_dir):
    """Spending allowed by elapsed time."""
    e = v.table(spark, sf_dir, "events")
    start = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t0"))
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("t0")) / 1e6
    return e.crossJoin(F.broadcast(start)).select("event_id", v.r6(1000 * F.least(F.lit(1.0), (elapsed + 900) / 2592000.0)).alias("allowed"))  # one row
