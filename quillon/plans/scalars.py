"""Scalar functions: strings, hashes, numbers, JSON, arrays, dates (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.functions import text as t

from . import views as v
from .registry import query


@query("parse_labels", "WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[+_|,;\\s]+'), lambda x: x <> '') AS toks FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(toks, lambda x: length(x) <= 3))), '+') AS targets, len(list_distinct(list_filter(toks, lambda x: length(x) > 3)))::INT AS unknown FROM p")
def parse_labels(spark, sf_dir):
    """Distinct sorted targets of a label, and how many tokens are unknown."""
    toks = t.label_tokens(F.col("text"))
    known = F.filter(toks, lambda x: F.length(x) <= 3)
    return v.table(spark, sf_dir, "documents").select("doc_id", t.canonical_key(known).alias("targets"), F.size(F.array_distinct(F.filter(toks, lambda x: F.length(x) > 3))).alias("unknown"))


@query("canonical_key", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey::VARCHAR))), '+') AS key FROM lineitem GROUP BY 1")
def canonical_key(spark, sf_dir):
    """C02."""
    return v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(t.canonical_key(F.collect_list(F.col("l_partkey").cast("string"))).alias("key"))


@query("label_tokens", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name, '[ #_-]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ENSG)?\\d+$')), ' ') AS tokens FROM part")
def label_tokens(spark, sf_dir):
    """Tokens without guide numbers and accession ids."""
    toks = F.filter(F.split("p_name", "[ #_-]+"), lambda x: (x != "") & ~x.rlike(r"^(ENSG)?\d+$"))
    return v.table(spark, sf_dir, "part").select("p_partkey", F.array_join(toks, " ").alias("tokens"))


@query("hypothesis_key", "SELECT item_id, 'H_' || substr(sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))), ' ')), 1, 10) AS key FROM benchmark")
def hypothesis_key(spark, sf_dir):
    """A hash of the bag of words."""
    return v.table(spark, sf_dir, "benchmark").select("item_id", t.bag_key(F.col("text")).alias("key"))


@query("canonical_hash", """SELECT o_orderkey, sha256('{"cust":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def canonical_hash(spark, sf_dir):
    """A hash of canonical JSON, keys sorted."""
    row = F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(row), 256).alias("hash"))


@query("text_digests", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def text_digests(spark, sf_dir):
    """C06."""
    return v.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("regex_features", "SELECT page_id, nullif(regexp_extract(url, '/(\\d+)', 1), '')::BIGINT AS number, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, CASE WHEN contains(html, '<aside') THEN 1 ELSE 0 END AS aside FROM pages")
def regex_features(spark, sf_dir):
    """Numbers, counts and flags by pattern; an open number is NULL."""
    return v.table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).cast("long").alias("number"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.contains("html", F.lit("<aside")).cast("int").alias("aside"))


@query("numeric_parse", "WITH r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN floor(p_retailprice)::INT || '%' ELSE p_size || '.5' END AS raw FROM part) SELECT p_partkey, CASE WHEN raw IN ('NA', '', 'NaN') THEN NULL WHEN raw LIKE '%\\%' ESCAPE '\\' THEN round(replace(raw, '%', '')::DOUBLE / 100, 4) ELSE round(raw::DOUBLE, 6) END AS x FROM r")
def numeric_parse(spark, sf_dir):
    """NA and empty are NULL, per cent become shares."""
    m = F.col("p_size") % 4
    raw = F.when(m == 0, "NA").when(m == 1, "").when(m == 2, F.concat(F.floor("p_retailprice").cast("int").cast("string"), F.lit("%"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return v.table(spark, sf_dir, "part").select("p_partkey", t.parse_number(raw).alias("x"))


@query(
    "sequence_features",
    """WITH s AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)
SELECT doc_id, round(len(regexp_extract_all(s, '[GC]'))::DOUBLE / nullif(length(s), 0), 6) AS gc, len(regexp_extract_all(s, 'CG'))::BIGINT AS cpg, len(regexp_extract_all(s, 'ATG'))::BIGINT AS atg, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS revcomp FROM s""",
)
def sequence_features(spark, sf_dir):
    """GC share, CpG and ATG counts, reverse complement."""
    s = v.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    n = lambda p: F.regexp_count("s", F.lit(p)).cast("long")
    return s.select("doc_id", v.r6(n("[GC]") / F.nullif(F.length("s"), F.lit(0))).alias("gc"), n("CG").alias("cpg"), n("ATG").alias("atg"), F.md5(F.reverse(F.translate("s", "ACGT", "TGCA"))).alias("revcomp"))


@query("log2_fold_change", f"WITH {v.DELTA} SELECT pert, gene, round(log2((exp(mean) - 1 + 1e-9) / (exp(control_mean) - 1 + 1e-9)), 5) AS lfc FROM delta")
def log2_fold_change(spark, sf_dir):
    """C10."""
    return v.delta_view(spark, sf_dir).select("pert", "gene", F.round(F.log2((F.expm1("mean") + 1e-9) / (F.expm1("control_mean") + 1e-9)), 5).alias("lfc"))


@query("spearman_brown", f"WITH {v.DELTA}, r AS (SELECT pert, {v.sql_pearson('mean', 'control_mean')} AS r FROM delta GROUP BY 1) SELECT pert, round(CASE WHEN 1 + r > 0 THEN 2 * r / (1 + r) ELSE -1.0 END, 6) AS full_r, round(sqrt(least(1.0, greatest(0.0, CASE WHEN 1 + r > 0 THEN 2 * r / (1 + r) ELSE -1.0 END))), 6) AS ceiling FROM r")
def spearman_brown(spark, sf_dir):
    """C11."""
    r = v.delta_view(spark, sf_dir).groupBy("pert").agg(stats.pearson(F.col("mean"), F.col("control_mean")).alias("r"))
    full = stats.spearman_brown(F.col("r"), 2)
    return r.select("pert", v.r6(full).alias("full_r"), v.r6(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), full)))).alias("ceiling"))


@query("wilson_interval", "WITH k AS (SELECT event_type, count(*) FILTER (value > 50)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT event_type, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM k")
def wilson_interval(spark, sf_dir):
    """C12."""
    k = v.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return k.select("event_type", v.r6(low).alias("low"), v.r6(high).alias("high"))


@query("cells_needed", f"WITH {v.NORM}, s AS (SELECT gene, stddev_pop(x) AS sd FROM norm WHERE pert = 0 GROUP BY 1), d AS (SELECT gene, avg(x) AS m FROM norm WHERE pert = 1 GROUP BY 1), c AS (SELECT gene, avg(x) AS m FROM norm WHERE pert = 0 GROUP BY 1) SELECT gene, CASE WHEN d.m = c.m THEN NULL WHEN sd = 0 THEN 1 ELSE ceil(round(2 * pow(2.8 * sd / abs(d.m - c.m), 2), 6))::BIGINT END AS cells FROM s JOIN d USING (gene) JOIN c USING (gene)")
def cells_needed(spark, sf_dir):
    """Cells a side to detect a difference; NULL at none, 1 without spread."""
    x = v.normalised(v.counts(spark, sf_dir)).where("pert in (0, 1)")
    mean = lambda p: F.avg(F.when(F.col("pert") == p, F.col("x")))
    g = x.groupBy("gene").agg(F.stddev_pop(F.when(F.col("pert") == 0, F.col("x"))).alias("sd"), (mean(1) - mean(0)).alias("d"))
    return g.where("d is not null and sd is not null").select("gene", F.when(F.col("d") != 0, F.when(F.col("sd") == 0, 1).otherwise(F.ceil(F.round(2 * F.pow(2.8 * F.col("sd") / F.abs("d"), F.lit(2.0)), 6)))).cast("long").alias("cells"))


@query("grid_alpha", "SELECT p_partkey, arg_min(g, abs(log10(g) - log10(p_retailprice / 10)) * 1e6 - g / 1e9) AS alpha FROM part CROSS JOIN (VALUES (1.0::DOUBLE), (10.0), (100.0), (1000.0)) AS t(g) GROUP BY 1")
def grid_alpha(spark, sf_dir):
    """C14: nearest value of a logarithmic grid, ties to the larger."""
    grid = F.array(*(F.lit(g) for g in (1.0, 10.0, 100.0, 1000.0)))
    gap = F.transform(grid, lambda g: F.struct(F.abs(F.log10(g) - F.log10(F.col("p_retailprice") / 10)).alias("d"), (-g).alias("g")))
    return v.table(spark, sf_dir, "part").select("p_partkey", (-F.array_min(gap)["g"]).alias("alpha"))


@query("modality_sign", "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) <> lower(substr(o_orderpriority, 3, 1)) THEN -1 ELSE 1 END AS sign FROM orders")
def modality_sign(spark, sf_dir):
    """C15."""
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.lower("o_orderstatus") != F.lower(F.substring("o_orderpriority", 3, 1)), -1).otherwise(1).alias("sign"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    """Tolerant JSON decoding."""
    return v.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("first_json_object", "SELECT event_id, regexp_extract('text ```json ' || props || ' ``` more', '\\{[\\s\\S]*\\}') AS object FROM events")
def first_json_object(spark, sf_dir):
    """C17: the JSON object inside fenced text."""
    return v.table(spark, sf_dir, "events").select("event_id", F.regexp_extract(F.concat(F.lit("text ```json "), "props", F.lit(" ``` more")), r"\{[\s\S]*\}", 0).alias("object"))


@query("alias_pairs", "SELECT c_custkey, c_mktsegment || '=' || c_nationkey AS raw, c_nationkey::VARCHAR AS new FROM customer")
def alias_pairs(spark, sf_dir):
    """OLD=NEW pairs."""
    raw = F.concat("c_mktsegment", F.lit("="), F.col("c_nationkey").cast("string"))
    return v.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), F.str_to_map(raw, F.lit(","), F.lit("="))[F.col("c_mktsegment")].alias("new"))


@query("arm_label", "SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ', continued' ELSE '' END || CASE WHEN o_custkey % 4 = 0 THEN ', external' ELSE '' END AS arm FROM orders")
def arm_label(spark, sf_dir):
    """A label of the parts that apply."""
    return v.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(", ", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "continued"), F.when(F.col("o_custkey") % 4 == 0, "external")).alias("arm"))


@query("epoch_minutes", "SELECT event_id, round((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 60, 4) AS minutes FROM events")
def epoch_minutes(spark, sf_dir):
    """C20: minutes since the start of a run."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.table(spark, sf_dir, "events").select("event_id", F.round((us - F.min(us).over(Window.partitionBy("user_id"))) / 6e7, 4).alias("minutes"))


@query("reshape_columns", "SELECT vec_id, 'e[' || i || ']' AS name, round(embedding[i + 1]::DOUBLE, 5) AS value FROM embeddings, (SELECT unnest(range(4))::INT AS i)")
def reshape_columns(spark, sf_dir):
    """Named columns of a vector."""
    return v.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x")).select("vec_id", F.format_string("e[%d]", "i").alias("name"), F.round(F.col("x").cast("double"), 5).alias("value"))


@query("classify_shape", "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'table' ELSE 'other' END AS shape FROM events")
def classify_shape(spark, sf_dir):
    """The kind of a document by the type of its fields."""
    return v.table(spark, sf_dir, "events").select("event_id", F.when(F.get_json_object("props", "$.k").rlike(r"^-?\d+$"), "table").otherwise("other").alias("shape"))


@query("pair_key", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_partkey) = 1 THEN min(l_partkey) || '+ctrl' ELSE array_to_string(list_sort(list_distinct(list(l_partkey::VARCHAR))), '+') END AS condition FROM lineitem GROUP BY 1")
def pair_key(spark, sf_dir):
    """A single target gets a control partner."""
    targets = F.array_sort(F.collect_set(F.col("l_partkey").cast("string")))
    g = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(targets.alias("t"))
    return g.select("l_orderkey", F.when(F.size("t") == 1, F.concat(F.col("t")[0], F.lit("+ctrl"))).otherwise(F.array_join("t", "+")).alias("condition"))


@query("classify_shapes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'screen' WHEN 1 THEN 'table' WHEN 2 THEN 'sets' WHEN 3 THEN 'network' WHEN 4 THEN 'list' ELSE 'other' END AS shape FROM events")
def classify_shapes(spark, sf_dir):
    """The six kinds of a JSON document, by the types of what it holds."""
    k = F.col("event_id").cast("string")
    forms = [
        F.concat(F.lit('{"genes":["a"],"perts":{"p'), k, F.lit('":{"delta":[1.5]}}}')),
        F.concat(F.lit('{"r'), k, F.lit('":{"x":1},"s":{"y":"z"}}')),
        F.concat(F.lit('{"s'), k, F.lit('":["a","b"],"t":[]}')),
        F.concat(F.lit('[["a","g'), k, F.lit('",1.0],["b","a",-1.0]]')),
        F.concat(F.lit('["a","g'), k, F.lit('"]')),
        k,
    ]
    doc = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return v.table(spark, sf_dir, "events").select("event_id", t.json_shape(doc).alias("shape"))
