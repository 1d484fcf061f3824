"""Mixing sources to target weights by hierarchical budgets (operator 3), in DataFrame operations only.

Documents form a tree: domain, language, source. The token budget is dealt from the root to the
leaves in proportion to the weights. No node gets more than it can give (its tokens times max_epochs):
what it lacks goes to its siblings by their weights, and only what all siblings cannot take
was never theirs but their ancestors' siblings', since a node's own limit is the sum of its leaves'. A leaf then
reads its documents in the order of a seeded hash, a new order each epoch, and takes the first
tokens of that stream up to its budget; the last document is cut.

Defined cases: tokens are runs of characters other than space, tab, line feed and carriage return. A null or empty text
has no tokens and none is taken. A null domain, language or source is a node named ''. Null ids are read as ''.
Rows that repeat an id count each; where they stand at a cut, they are cut alike. Shares are rounded down, so
fewer tokens than a node has children may stay unused. Weights are positive integers; the default is 1. An empty
table gives no rows. Columns that are not named here pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import salted_join, stage, table

#: Target weights of the production query, by level, and the seed of the epochs' orders.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 2}
SHARE, EPOCHS, SEED = (3, 5), 2, 17
LEAF = ["_domain", "_lang", "_source"]


def domain_of(source: Column) -> Column:
    """Domain of a source: 'd' and the code of its last character modulo 4."""
    return F.concat(F.lit("d"), (F.ascii(F.right(F.coalesce(source, F.lit("")), F.lit(1))) % 4).cast("string"))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+")).cast("long")


def token_prefix(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[ \t\n\r]*[^ \t\n\r]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out.cast("long")


def _deal(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Fill the children of each parent: (budget, cap, w) -> share, by water level over cap / w."""
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name)
    whole = Window.partitionBy(*parents)
    big = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products stay below 38 digits
    rows = children.withColumns({"upto": F.sum("cap").over(order), "after": F.sum("w").over(whole) - F.sum("w").over(order)})
    full = big(F.col("budget") - F.col("upto")) * big(F.col("w")) >= big(F.col("cap")) * big(F.col("after"))
    rows = rows.withColumn("full", full & (F.col("budget") >= F.col("upto")))
    rows = rows.withColumns({"left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)})
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(left as decimal(19,0)) * cast(w as decimal(19,0)) div open as bigint)"))
    return rows.withColumn("share", share.cast("long")).drop("upto", "after", "full", "left", "open")


def budgets(leaves: DataFrame, share: tuple[int, int], epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    root = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {share[0]} div {share[1]}").alias("budget"))
    domains = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(root)).withColumns({"w": _weight("_domain", weights[0]), "root": F.lit(0)})  # one row
    domains = _deal(domains, ["root"], "_domain").select("_domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap")).join(domains, "_domain").withColumn("w", _weight("_lang", weights[1]))
    langs = _deal(langs, ["_domain"], "_lang").select("_domain", "_lang", F.col("share").alias("budget"))
    sources = leaves.join(langs, ["_domain", "_lang"]).withColumn("w", _weight("_source", weights[2]))
    return _deal(sources, ["_domain", "_lang"], "_source").select(*LEAF, *(c for c in ("tokens", "rows") if c in leaves.columns), F.col("share").alias("budget"))


def _order(epoch: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)


def _marked(docs: DataFrame, domain: Column) -> DataFrame:
    empty = F.lit("")
    return docs.withColumns({"_id": F.col("doc_id"), "_domain": F.coalesce(domain, empty), "_lang": F.coalesce("lang", empty), "_source": F.coalesce("source", empty), "_n": count_tokens(F.col("text"))})


def _plan(docs: DataFrame, domain, share, epochs, weights, seed) -> tuple[DataFrame, DataFrame, int]:
    """Cuts of the leaves, where the documents of the part that holds the cut begin, and the digits that name a part."""
    counted = stage(_marked(docs, domain).select("_id", *LEAF, "_n"), "op3-counted")
    leaves = counted.groupBy(*LEAF).agg(F.sum("_n").alias("tokens"), F.count("*").alias("rows"))
    dealt = budgets(leaves, share, epochs, weights).where("tokens > 0")
    dealt = stage(dealt.select(*LEAF, "rows", F.expr("cast(budget div tokens as int)").alias("_full"), (F.col("budget") % F.col("tokens")).alias("_rest")), "op3-budgets")
    # One task sorts the parts of a leaf, one the rows of a part: there are about as many parts as a part of the largest leaf has rows.
    largest = dealt.agg(F.max("rows").alias("n")).head().n or 0
    digits = next(d for d in range(1, 17) if largest <= 256**d)
    placed = salted_join(counted, dealt, LEAF, "_id", "rows").withColumn("_h", _order(F.col("_full"), seed)).withColumn("_part", F.substring("_h", 1, digits))
    parts = placed.groupBy(*LEAF, "_rest", "_part").agg(F.sum("_n").alias("n"))  # 16 ** digits a leaf at most
    upto = parts.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("_part")))
    cut = upto.where("upto - n < _rest and upto >= _rest").select(*LEAF, F.col("_part").alias("_cut"), (F.col("upto") - F.col("n")).alias("_before"))
    cuts = stage(dealt.join(cut, LEAF, "left"), "op3-cuts")
    inside = salted_join(counted, cuts, LEAF, "_id", "rows").withColumn("_h", _order(F.col("_full"), seed)).where(F.substring("_h", 1, digits) == F.col("_cut"))
    running = Window.partitionBy(*LEAF).orderBy("_h", "_id")
    begins = inside.withColumn("_begin", F.col("_before") + F.sum("_n").over(running) - F.col("_n")).groupBy(*LEAF, "_id").agg(F.min("_begin").alias("_begin"))
    return cuts, stage(begins, "op3-begins"), digits


def take(docs: DataFrame, domain: Column | None = None, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), seed: int = SEED) -> DataFrame:
    """docs with _domain, _n (tokens), _full (whole epochs) and _some (tokens of the last, partial epoch)."""
    domain = domain_of(F.col("source")) if domain is None else domain
    cuts, begins, digits = _plan(docs, domain, share, epochs, weights, seed)
    rows = salted_join(_marked(docs, domain), cuts, LEAF, "_id", "rows", how="left").withColumn("_part", F.substring(_order(F.col("_full"), seed), 1, digits))
    rows = rows.join(begins.withColumnsRenamed({"_id": "_b", "_domain": "_bd", "_lang": "_bl", "_source": "_bs"}), F.expr("_id <=> _b and _domain = _bd and _lang = _bl and _source = _bs"), "left")
    inside = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_rest") - F.col("_begin")))
    some = F.when(F.col("_cut").isNull(), 0).when(F.col("_part") < F.col("_cut"), F.col("_n")).when(F.col("_part") == F.col("_cut"), inside).otherwise(0)
    return rows.withColumns({"_some": F.coalesce(some, F.lit(0)).cast("long"), "_full": F.coalesce("_full", F.lit(0))})


def mix(docs: DataFrame, domain: Column | None = None, **options) -> DataFrame:
    """The selected documents with their columns: a row for each whole epoch, and the prefix taken in the last one."""
    # The columns travel as one, so that none of them can be taken for a column of this plan.
    domain = domain_of(docs["source"]) if domain is None else domain
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), "doc_id", "text", "lang", "source", domain.alias("_dom"))
    rows = take(whole, F.col("_dom"), **options)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("_n") > 0, F.col("_full")).otherwise(0)), F.when(F.col("_some") > 0, F.array("_some")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_take", F.explode(copies))
    own = lambda c: F.col("_doc").getField(c)
    text = F.when((F.col("_take") < 0) | (F.col("_take") >= F.col("_n")), own("text")).otherwise(token_prefix(own("text"), F.col("_take")))
    return rows.select(*(text.alias("text") if c == "text" else own(c).alias(c) for c in docs.columns))


def op3_mixing_sources(spark, sf_dir: str) -> DataFrame:
    rows = take(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_n").alias("n_tokens"), F.col("_full").cast("int").alias("epochs"), F.col("_some").alias("part_tokens"), (F.col("_full") * F.col("_n") + F.col("_some")).cast("long").alias("taken_tokens"))


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _deal_sql(name: str, children: str, parents: str, key: str) -> str:
    over = f"(PARTITION BY {parents} ORDER BY cap::DOUBLE / w, {key})"
    whole = f"(PARTITION BY {parents})"
    return f"""
{name}_a AS (SELECT *, sum(cap) OVER {over} AS upto, sum(w) OVER {whole} - sum(w) OVER {over} AS after FROM ({children})),
{name}_b AS (SELECT *, budget >= upto AND (budget - upto)::HUGEINT * w >= cap::HUGEINT * after AS isfull FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(CASE WHEN isfull THEN cap END) OVER {whole}, 0) AS rem, sum(CASE WHEN NOT isfull THEN w END) OVER {whole} AS unmet FROM {name}_b),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN isfull THEN cap ELSE (rem::HUGEINT * w) // unmet END AS budget FROM {name}_c)"""


def mixing_sql(source: str = "documents", share=SHARE, epochs=EPOCHS, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), seed=SEED) -> str:
    """SQL for the rows of take(): common table expressions that end in `taken`."""
    return rf"""
marked AS (
  SELECT doc_id, 'd' || (ascii(right(coalesce(source, ''), 1)) % 4) AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::BIGINT AS n FROM {source}),
leaves AS (SELECT domain, l, s, sum(n) AS tokens, sum(n) * {epochs} AS cap FROM marked GROUP BY ALL),
total AS (SELECT coalesce(sum(tokens), 0) * {share[0]} // {share[1]} AS budget FROM leaves),
{_deal_sql("d_dealt", f"SELECT domain, cap, budget, {_case('domain', weights[0])} AS w, 0 AS root FROM (SELECT domain, sum(cap) AS cap FROM leaves GROUP BY domain), total", "root", "domain")},
{_deal_sql("l_dealt", f"SELECT domain, l, x.cap, d.budget, {_case('l', weights[1])} AS w FROM (SELECT domain, l, sum(cap) AS cap FROM leaves GROUP BY ALL) x JOIN d_dealt d USING (domain)", "domain", "l")},
{_deal_sql("s_dealt", f"SELECT domain, l, s, tokens, x.cap, d.budget, {_case('s', weights[2])} AS w FROM leaves x JOIN l_dealt d USING (domain, l)", "domain, l", "s")},
cuts AS (SELECT domain, l, s, (budget // tokens)::INT AS whole, budget % tokens AS rest FROM s_dealt WHERE tokens > 0),
ordered AS (SELECT m.*, whole, rest, sum(n) OVER (PARTITION BY domain, l, s ORDER BY sha256('{seed}:' || whole || ':' || doc_id), doc_id) - n AS begins FROM marked m LEFT JOIN cuts USING (domain, l, s)),
taken AS (SELECT *, greatest(0, least(n, coalesce(rest, 0) - begins)) AS part FROM ordered)"""


OP3_SQL = f"WITH {mixing_sql()} SELECT doc_id, domain, lang, source, n AS n_tokens, coalesce(whole, 0)::INT AS epochs, part::BIGINT AS part_tokens, (coalesce(whole, 0) * n + part)::BIGINT AS taken_tokens FROM taken"
