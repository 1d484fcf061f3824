"""Layouts of measurement matrices in tables, and a seeded generator of a synthetic screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, NumericType, StringType


def layout(df: DataFrame, row: str) -> str:
    """How a table holds a matrix: 'vector' (an array a row), 'long' (row, column, value, sparse) or 'dense' (a column a measure).

    Two columns beside the row are a long matrix if the first names a column, by text or by a whole number.
    """
    others = [f for f in df.schema.fields if f.name != row]
    if any(isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType) for f in others):
        return "vector"
    if len(others) == 2 and isinstance(others[0].dataType, (IntegralType, StringType)) and isinstance(others[1].dataType, NumericType):
        return "long"
    if others and all(isinstance(f.dataType, NumericType) for f in others):
        return "dense"
    raise ValueError(f"no layout of a matrix in {df.schema.simpleString()}")


def to_long(df: DataFrame, row: str) -> DataFrame:
    """(row, col, value) of a matrix in any layout; zeros and NULLs are left out."""
    kind, others = layout(df, row), [f.name for f in df.schema.fields if f.name != row]
    if kind == "vector":
        name = next(f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType))
        out = df.select(F.col(row).alias("row"), F.posexplode(name).alias("col", "value"))
    elif kind == "dense":
        out = df.select(F.col(row).alias("row"), F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in others))))
    else:
        out = df.select(F.col(row).alias("row"), F.col(others[0]).alias("col"), F.col(others[1]).alias("value"))
    return out.select("row", F.col("col").cast("string").alias("col"), F.col("value").cast("double").alias("value")).where("value <> 0")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for each combination of keys, from 52 bits of a hash that any engine has."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def synthetic_screen(spark: SparkSession, genes: int, groups: int, cells: int, controls: int, seed: int) -> DataFrame:
    """(cell, pert, gene, x): a screen of modules, knocked-down targets and noise.

    Gene g has the level 0.2 + 3 u u' and belongs to one of genes / 12 modules. Group p, from 1 on, knocks gene 3 p down by
    85 per cent, its module's other genes by 20 per cent, and a cell adds noise. Values are clipped at 0. Group 0 are the
    controls. Every number comes from a hash of its place, so the table can be made in parts of any size.
    """
    modules = max(1, genes // 12)
    g = spark.range(genes).select(F.col("id").alias("gene")).select("gene", (0.2 + 3 * uniform(seed, F.lit("a"), F.col("gene")) * uniform(seed, F.lit("b"), F.col("gene"))).alias("level"), F.floor(uniform(seed, F.lit("m"), F.col("gene")) * modules).alias("module"))
    total = controls + groups * cells
    c = spark.range(total).select(F.col("id").alias("cell"), F.when(F.col("id") < controls, 0).otherwise(F.floor((F.col("id") - controls) / cells) + 1).alias("pert"))
    targets = g.where(F.col("gene") % 3 == 0).select((F.col("gene") / 3).cast("long").alias("pert"), F.col("gene").alias("target"), F.col("module").alias("hit")).where(F.col("pert").between(1, groups))
    c = c.join(targets, "pert", "left")
    noise = 0.7 * (uniform(seed, F.lit("n"), F.col("cell"), F.col("gene")) - 0.5)
    share = F.when(F.col("target") == F.col("gene"), 0.15).when(F.col("hit") == F.col("module"), 0.8).otherwise(1.0)
    # The genes are a parameter's size; the cells are what grows.
    return c.crossJoin(F.broadcast(g)).select("cell", "pert", "gene", F.greatest(F.lit(0.0), F.col("level") * share + noise).alias("x"))
