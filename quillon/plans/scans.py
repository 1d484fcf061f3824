"""Scans, text formats and run tables (S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators.numbering import chunk_plan, runs
from quillon.sources import formats

from . import views as v
from .registry import query


@query("common_genes_scan", "WITH c AS (SELECT p_brand AS g FROM part WHERE p_size <= 4 GROUP BY 1 HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)) SELECT p_type AS file, p_brand AS gene, count(*) AS n FROM part WHERE p_brand IN (SELECT g FROM c) GROUP BY 1, 2")
def common_genes_scan(spark, sf_dir):
    """Several inputs, only the measures that all of them have."""
    part = v.table(spark, sf_dir, "part")
    files = part.agg(F.count_distinct("p_type").alias("k"))
    common = part.where("p_size <= 4").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).crossJoin(F.broadcast(files)).where("n = k")  # one row
    return part.join(common, "p_brand", "left_semi").groupBy(F.col("p_type").alias("file"), F.col("p_brand").alias("gene")).agg(F.count("*").alias("n"))


@query("row_set_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 997 = 3")
def row_set_scan(spark, sf_dir):
    """Requested rows only, by a filter the scan can use."""
    return v.table(spark, sf_dir, "lineitem").where("l_orderkey % 997 = 3").select("l_orderkey", "l_linenumber", "l_quantity")


@query("describe_matrix", f"WITH {v.COUNTS} SELECT count(DISTINCT cell) AS cells, count(DISTINCT gene) AS genes, count(DISTINCT pert) AS labels, round(sum(cnt), 2) AS total FROM cells")
def describe_matrix(spark, sf_dir):
    """S03."""
    return v.counts(spark, sf_dir).agg(F.count_distinct("cell").alias("cells"), F.count_distinct("gene").alias("genes"), F.count_distinct("pert").alias("labels"), F.round(F.sum("cnt"), 2).alias("total"))


@query("label_codes", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 'zzz' ELSE o_orderpriority END) - 1 END::BIGINT AS code FROM orders")
def label_codes(spark, sf_dir):
    """Categories as codes, -1 for missing; categories come from a small distinct table."""
    from pyspark.sql import Window

    o = v.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label"))
    codes = o.where("label is not null").select("label").distinct().withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")).cast("long") - 1)
    return o.join(codes, "label", "left").select("o_orderkey", F.coalesce("code", F.lit(-1).cast("long")).alias("code"))


@query("symbol_choice", "SELECT p_partkey, CASE WHEN (SELECT avg(CASE WHEN regexp_matches(p_brand, '^ENS[A-Z]*\\d{6,}') THEN 1.0 ELSE 0.0 END) FROM part) > 0.5 THEN p_name ELSE p_brand END AS symbol FROM part")
def symbol_choice(spark, sf_dir):
    """S05."""
    part = v.table(spark, sf_dir, "part")
    return part.select("p_partkey", formats.symbol_column(part, "p_brand", "p_name").alias("symbol"))


@query("stream_sums", "WITH t AS (SELECT l_orderkey, sum(l_quantity) AS tot FROM lineitem GROUP BY 1) SELECT l_returnflag, l_suppkey, round(sum(ln(1 + l_quantity * 1e4 / tot)), 4) AS s FROM lineitem JOIN t USING (l_orderkey) GROUP BY 1, 2")
def stream_sums(spark, sf_dir):
    """S07, ST1: normalised sums of the needed columns by group; totals need all columns."""
    line = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    totals = line.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tot"))
    x = F.log1p(F.col("l_quantity") * 1e4 / F.col("tot"))
    return line.join(totals, "l_orderkey").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum(x), 4).alias("s"))


@query("consecutive_runs", "WITH g AS (SELECT p_type, p_partkey AS c, p_partkey - row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS island FROM part) SELECT p_type, min(c) AS first, max(c) AS last, count(*) AS n FROM g GROUP BY p_type, island")
def consecutive_runs(spark, sf_dir):
    """Maximal runs of consecutive columns of a kind."""
    return runs(v.table(spark, sf_dir, "part"), ["p_type"], "p_partkey").select("p_type", "first", "last", "n")


@query(
    "bounded_chunks",
    """WITH RECURSIVE s AS (SELECT p_type AS t, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i, p_partkey AS k, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS z FROM part),
p AS (SELECT *, sum(z) OVER (PARTITION BY t ORDER BY i)::BIGINT AS upto FROM s),
n AS (SELECT a.t, a.i, coalesce(min(b.i), max(a.m)) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY t) AS m FROM p) a LEFT JOIN p b ON b.t = a.t AND b.i > a.i AND (b.i - a.i >= 24 OR b.upto - (a.upto - a.z) > 400) GROUP BY a.t, a.i),
c AS (SELECT t, 0::BIGINT AS chunk, i, nxt FROM n WHERE i = 0 UNION ALL SELECT c.t, c.chunk + 1, n.i, n.nxt FROM c JOIN n ON n.t = c.t AND n.i = c.nxt)
SELECT c.t AS p_type, chunk, min(k) AS first, max(k) AS last, count(*) AS n, sum(z)::BIGINT AS size FROM c JOIN p ON p.t = c.t AND p.i >= c.i AND p.i < c.nxt GROUP BY 1, 2""",
)
def bounded_chunks(spark, sf_dir):
    """Columns of a kind in chunks of at most 24 columns with at most 400 stored values, at least one column each."""
    stored = v.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("z"))
    columns = v.table(spark, sf_dir, "part").select("p_type", "p_partkey").join(stored, F.col("p_partkey") == F.col("l_partkey"), "left")
    return chunk_plan(columns, ["p_type"], "p_partkey", "z", 24, 400).select("p_type", "chunk", "first", "last", "n", "size")


@query("value_sampler", "WITH t AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 5) SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey IN (SELECT l_suppkey FROM t) OR l_orderkey % 101 = 0) AND l_quantity <> 0")
def value_sampler(spark, sf_dir):
    """Evenly spaced rows and the five fullest groups (sampling is the feature)."""
    line = v.table(spark, sf_dir, "lineitem").where("l_quantity <> 0")
    top = line.groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(5).select("l_suppkey", F.lit(True).alias("top"))
    return line.join(F.broadcast(top), "l_suppkey", "left").where("top or l_orderkey % 101 = 0").select("l_orderkey", "l_linenumber")  # five rows


@query("label_set", f"WITH {v.PROFILE} SELECT pert, gene, round(mean, 6) AS mean FROM profile WHERE pert % 5 = 3")
def label_set(spark, sf_dir):
    """S10."""
    return v.profiles(v.normalised(v.counts(spark, sf_dir))).where("pert % 5 = 3").select("pert", "gene", v.r6("mean").alias("mean"))


@query("public_context", f"WITH {v.NORM}, n AS (SELECT count(DISTINCT cell) AS n FROM norm WHERE pert = 0) SELECT gene, round(sum(x) / max(n), 6) AS control_mean, round(sqrt(greatest(0, sum(x * x) / max(n) - (sum(x) / max(n)) * (sum(x) / max(n)))), 6) AS control_sd FROM norm, n WHERE pert = 0 GROUP BY 1")
def public_context(spark, sf_dir):
    """Control mean and population sd, zeros counted."""
    x = v.normalised(v.counts(spark, sf_dir)).where("pert = 0")
    n = x.agg(F.count_distinct("cell").alias("n"))
    mean = F.sum("x") / F.max("n")
    var = F.sum(F.col("x") * F.col("x")) / F.max("n") - mean * mean
    return x.crossJoin(F.broadcast(n)).groupBy("gene").agg(v.r6(mean).alias("control_mean"), v.r6(F.sqrt(F.greatest(F.lit(0.0), var))).alias("control_sd"))  # one row


@query("gmt_reader", "SELECT DISTINCT 'O' || l_orderkey AS set_name, l_partkey::VARCHAR AS member FROM lineitem")
def gmt_reader(spark, sf_dir):
    """Gene-set lines written and read again."""
    name = F.concat(F.lit("O"), F.col("l_orderkey"))
    member = F.concat(F.col("l_partkey"), F.lit(",1.0"))
    lines = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\t", name, F.lit("desc"), F.array_join(F.collect_set(member), "\t")).alias("value"))
    return formats.gmt(lines.select("value"))


@query("obo_reader", "SELECT 'T:' || o_orderkey AS id, 'T:' || (o_orderkey // 2) AS parent FROM orders WHERE o_orderkey >= 2 AND o_orderstatus <> 'P'")
def obo_reader(spark, sf_dir):
    """Ontology stanzas; obsolete terms are dropped."""
    o = v.table(spark, sf_dir, "orders").where("o_orderkey >= 2")
    key = F.col("o_orderkey")
    body = F.concat(F.lit("\nid: T:"), key.cast("string"), F.lit("\nname: x\nalt_id: A:"), key.cast("string"), F.lit("\nis_a: T:"), F.expr("cast(o_orderkey div 2 as string)"), F.lit(" ! parent"), F.when(F.col("o_orderstatus") == "P", F.lit("\nis_obsolete: true")).otherwise(F.lit("")), F.lit("\n\n[Typedef]\nid: part_of"))
    return formats.obo(o.select(body.alias("value")))[0]


@query("gaf_reader", "SELECT DISTINCT 'C' || c_custkey AS symbol, 'GO:' || c_nationkey AS term, CASE c_custkey % 3 WHEN 0 THEN 'IDA' ELSE 'IMP' END AS code FROM customer WHERE c_custkey % 3 < 2 AND c_acctbal > 0")
def gaf_reader(spark, sf_dir):
    """Annotation lines filtered by evidence and qualifier."""
    code = F.element_at(F.array(F.lit("IDA"), F.lit("IMP"), F.lit("IEA")), (F.col("c_custkey") % 3 + 1).cast("int"))
    line = F.concat_ws("\t", F.lit("DB"), F.lit("id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.when(F.col("c_acctbal") > 0, "involved_in").otherwise("NOT|involved_in"), F.concat(F.lit("GO:"), F.col("c_nationkey").cast("string")), F.lit("ref"), code)
    return formats.gaf(v.table(spark, sf_dir, "customer").select(line.alias("value")), ["IDA", "IMP"])


@query("gtf_reader", "SELECT l_returnflag AS chrom, (l_partkey * 10) AS start, (l_partkey * 10 + l_quantity)::BIGINT AS \"end\", 'g' || l_suppkey AS gene FROM lineitem")
def gtf_reader(spark, sf_dir):
    """Feature lines with attributes as a map."""
    line = F.concat_ws("\t", "l_returnflag", F.lit("src"), F.lit("exon"), (F.col("l_partkey") * 10).cast("string"), (F.col("l_partkey") * 10 + F.col("l_quantity")).cast("long").cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "g'), F.col("l_suppkey").cast("string"), F.lit('"; tag "a"; tag "b";')))
    return formats.gtf(v.table(spark, sf_dir, "lineitem").select(line.alias("value"))).select("chrom", "start", "end", F.col("attributes")["gene_id"].alias("gene"))


@query("sequence_access", "WITH s AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents) SELECT doc_id AS id, upper(substr(s, 50, 2500)) AS seq FROM s WHERE length(s) >= 60")
def sequence_access(spark, sf_dir):
    """Sequences in chunks, ranges fetched by a join on the chunk, clipped at the end."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("text")).where("length(text) >= 60")
    chunks = formats.sequence_chunks(d.select(F.col("doc_id").alias("chrom"), F.col("text").alias("seq")))
    return formats.fetch(chunks, d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chrom"), F.lit(50).alias("start"), F.lit(2549).alias("end")))


@query("embedding_scan", "SELECT label, count(*) AS n, min(len(embedding))::BIGINT AS dims, round(avg(embedding[1]::DOUBLE), 5) AS first FROM embeddings GROUP BY 1")
def embedding_scan(spark, sf_dir):
    """Vectors by key, one common length."""
    return v.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"), F.round(F.avg(F.col("embedding")[0].cast("double")), 5).alias("first"))


@query("spend_by_provider", "SELECT role AS provider, count(*) AS calls, round(sum(length(text) * 0.000002::DOUBLE), 6) AS cost FROM conversations GROUP BY 1")
def spend_by_provider(spark, sf_dir):
    """S25, O19."""
    return v.table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("provider")).agg(F.count("*").alias("calls"), v.r6(F.sum(F.length("text") * F.lit(0.000002))).alias("cost"))


@query("run_loader", "SELECT c.c_custkey AS run, c.c_mktsegment AS arm, o.n AS orders, e.n AS events FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c.c_custkey")
def run_loader(spark, sf_dir):
    """Three tables of a run; an absent one is tolerated."""
    c = v.table(spark, sf_dir, "customer").selectExpr("c_custkey as run", "c_mktsegment as arm")
    o = v.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("orders"))
    e = v.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("events"))
    return c.join(o, "run", "left").join(e, "run", "left")


@query("coverage_errors", "SELECT p_partkey AS missing FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def coverage_errors(spark, sf_dir):
    """Keys a prediction lacks."""
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("missing")).join(v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("missing")), "missing", "left_anti")


@query("evaluator_cells", f"WITH {v.LOO} SELECT pert, gene, k, round(greatest(0, control_mean + pred), 6) AS x FROM loo CROSS JOIN (SELECT unnest(range(1, 4))::INT AS k) UNION ALL SELECT DISTINCT 0, gene, 0, round(control_mean, 6) FROM loo")
def evaluator_cells(spark, sf_dir):
    """Predicted cells, clipped at 0 and repeated, with the controls."""
    loo = v.loo_mean(v.delta_view(spark, sf_dir))
    x = F.greatest(F.lit(0.0), F.col("control_mean") + F.col("pred"))
    cells = loo.select("pert", "gene", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), v.r6(x).alias("x"))
    return cells.unionAll(loo.select(F.lit(0).alias("pert"), "gene", F.lit(0).alias("k"), v.r6("control_mean").alias("x")).distinct())


@query("guarded_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def guarded_columns(spark, sf_dir):
    """A view of the allowed columns; the scan reads no other."""
    return v.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


@query("content_measure", f"WITH {v.NORM} SELECT gene, round(count(*) FILTER (x > 0)::DOUBLE / (SELECT count(DISTINCT cell) FROM norm WHERE pert = 0), 6) AS share FROM norm WHERE pert = 0 GROUP BY 1")
def content_measure(spark, sf_dir):
    """Share of control cells in which a measure is not zero."""
    x = v.normalised(v.counts(spark, sf_dir)).where("pert = 0")
    n = x.agg(F.count_distinct("cell").alias("n"))
    return x.crossJoin(F.broadcast(n)).groupBy("gene").agg(v.r6(F.count_if(F.col("x") > 0) / F.max("n")).alias("share"))  # one row


@query(
    "external_screen",
    f"""WITH {v.NORM}, s AS (SELECT norm.* FROM norm JOIN orders ON o_orderkey = cell WHERE o_orderstatus = 'F'), g AS (SELECT pert, count(DISTINCT cell) AS n FROM s GROUP BY 1),
m AS (SELECT pert, gene, sum(x) AS t FROM s GROUP BY 1, 2), p AS (SELECT g.pert, gene, n, t / n AS mean FROM m JOIN g USING (pert))
SELECT a.pert, a.gene, a.n AS n_cells, round(a.mean - c.mean, 6) AS delta FROM p a JOIN p c ON c.gene = a.gene AND c.pert = 0 WHERE a.pert <> 0 AND a.n >= 250""",
)
def external_screen(spark, sf_dir):
    """Another screen's deltas against its own control, small targets dropped."""
    x = v.normalised(v.counts(spark, sf_dir))
    done = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell"))
    d = v.deltas(v.profiles(x.join(done, "cell", "left_semi")))
    return d.where("n_cells >= 250").select("pert", "gene", "n_cells", v.r6("delta").alias("delta"))
