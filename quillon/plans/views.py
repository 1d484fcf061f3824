"""The screen that the test tables stand for, as DataFrames and as SQL for the oracles.

A cell is an order, its label the nation of its customer (0: control), a measure (gene) is a part
brand, a count the quantity ordered. Every brand that a cell lacks counts as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.graph import cut

CONTROL = 0
SCALE = 1e4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a join or a group that one task sorts.
ROWS = 500_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The table, dealt by key to tasks of ROWS of so many rows where these are more than the cores; so the memory of one task does not grow with them.

    Smaller tables are left to Spark, which broadcasts or coalesces them.
    """
    n = rows // ROWS + 1
    return df.repartition(n, key) if n > df.sparkSession.sparkContext.defaultParallelism else df


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse long matrix (cell, pert, gene, cnt). The join, the groups and the windows over a cell share one shuffle."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("pert"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    n, m = line.count(), order.count()
    genes = dealt(line, "l_partkey", n).join(dealt(part, "l_partkey", n), "l_partkey").select(F.col("l_orderkey").alias("cell"), "gene", "l_quantity")
    perts = dealt(order, "o_custkey", m).join(dealt(customer, "o_custkey", m), "o_custkey").select(F.col("o_orderkey").alias("cell"), "pert")
    return dealt(genes, "cell", n).join(dealt(perts, "cell", n), "cell").groupBy("cell", "pert", "gene").agg(F.sum("l_quantity").alias("cnt"))


def normalised(matrix: DataFrame) -> DataFrame:
    """Adds x = log1p(cnt * 1e4 / total of the cell); totals of 0 or less count as 1."""
    total = F.sum("cnt").over(Window.partitionBy("cell"))
    return matrix.withColumn("x", F.log1p(F.col("cnt") * SCALE / F.when(total > 0, total).otherwise(1.0)))


def profiles(matrix: DataFrame) -> DataFrame:
    """(pert, gene, n_cells, mean): zeros count, so sums are divided by the cells of the group.

    The matrix is read once: its sums, and the cells that are met first in a row, are kept by group and measure.
    """
    first = (F.row_number().over(Window.partitionBy("cell", "pert").orderBy("gene")) == 1) & F.col("cell").isNotNull()
    sums = cut(matrix.select("pert", "gene", "x", first.alias("first")).groupBy("pert", "gene").agg(F.sum("x").alias("total"), F.count_if("first").alias("n")))
    cells = sums.groupBy("pert").agg(F.sum("n").alias("n_cells"))
    genes = sums.select("gene").distinct()
    grid = cells.crossJoin(genes)  # the groups times the measures, the size of the result; Spark broadcasts a side that is small
    return grid.join(sums.drop("n"), ["pert", "gene"], "left").select("pert", "gene", "n_cells", (F.coalesce("total", F.lit(0.0)) / F.col("n_cells")).alias("mean"))


def deltas(profile: DataFrame, control: int = CONTROL) -> DataFrame:
    """(pert, gene, n_cells, mean, control_mean, delta) of the groups other than the control."""
    base = profile.where(F.col("pert") == control).select("gene", F.col("mean").alias("control_mean"))
    return profile.where(F.col("pert") != control).join(base, "gene").select("pert", "gene", "n_cells", "mean", "control_mean", (F.col("mean") - F.col("control_mean")).alias("delta"))


def delta_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(profiles(normalised(counts(spark, sf_dir))))


def loo_mean(delta: DataFrame) -> DataFrame:
    """Adds pred: the mean delta of all other groups for the same measure."""
    w = Window.partitionBy("gene")
    return delta.withColumn("pred", (F.sum("delta").over(w) - F.col("delta")) / (F.count("*").over(w) - 1))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: SQL of the same views.
COUNTS = """cells AS (
  SELECT o_orderkey AS cell, c_nationkey AS pert, p_brand AS gene, sum(l_quantity) AS cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""
NORM = COUNTS + """,
norm AS (SELECT *, ln(1 + cnt * 1e4 / (CASE WHEN sum(cnt) OVER (PARTITION BY cell) > 0 THEN sum(cnt) OVER (PARTITION BY cell) ELSE 1 END)) AS x FROM cells)"""
PROFILE = NORM + """,
profile AS (
  SELECT g.pert, n.gene, g.n_cells, coalesce(s.total, 0) / g.n_cells AS mean
  FROM (SELECT pert, count(DISTINCT cell) AS n_cells FROM norm GROUP BY 1) g CROSS JOIN (SELECT DISTINCT gene FROM norm) n
  LEFT JOIN (SELECT pert, gene, sum(x) AS total FROM norm GROUP BY 1, 2) s ON s.pert = g.pert AND s.gene = n.gene)"""
DELTA = PROFILE + """,
delta AS (
  SELECT p.pert, p.gene, p.n_cells, p.mean, c.mean AS control_mean, p.mean - c.mean AS delta
  FROM profile p JOIN profile c ON c.pert = 0 AND c.gene = p.gene WHERE p.pert <> 0)"""
LOO = DELTA + """,
loo AS (SELECT *, (sum(delta) OVER (PARTITION BY gene) - delta) / (count(*) OVER (PARTITION BY gene) - 1) AS pred FROM delta)"""


def sql_pearson(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) * var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) ELSE 0.0 END"
