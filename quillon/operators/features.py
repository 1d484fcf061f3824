"""Registry of feature functions: DataFrame context in, (pert, gene, value) out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Feature = Callable[["Context"], DataFrame]
REGISTRY: dict[str, Feature] = {}


def register(name: str) -> Callable[[Feature], Feature]:
    if not name.isidentifier():
        raise ValueError(f"{name!r} is not an identifier")

    def add(f: Feature) -> Feature:
        REGISTRY[name] = f
        return f

    return add


@dataclass
class Context:
    """Views a feature may read; feature() composes and remembers."""

    delta: DataFrame
    targets: DataFrame
    edges: DataFrame | None = None
    sets: DataFrame | None = None
    memo: dict[str, DataFrame] = field(default_factory=dict)

    def feature(self, name: str) -> DataFrame:
        if name not in self.memo:
            self.memo[name] = REGISTRY[name](self)
        return self.memo[name]


def checked(block: DataFrame) -> DataFrame:
    """The block, failing the query at a value that is NULL or not finite."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return block.withColumn("value", F.when(bad, F.raise_error(F.lit("a feature gave a value that is not finite"))).otherwise(F.col("value")))


def smoke(name: str, context: Context) -> dict[str, bool]:
    """Is the feature finite, not constant, and the same when computed twice?"""
    a, b = REGISTRY[name](context), REGISTRY[name](context)
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    row = a.agg(F.count_if(bad).alias("bad"), F.var_pop("value").alias("var")).head()
    return {"finite": row.bad == 0, "varies": bool(row["var"] and row["var"] > 0), "deterministic": a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()}


@register("control_mean")
def control_mean(c: Context) -> DataFrame:
    return c.delta.select("pert", "gene", F.col("control_mean").alias("value"))


@register("mean_response")
def mean_response(c: Context) -> DataFrame:
    w = Window.partitionBy("gene")
    return c.delta.select("pert", "gene", ((F.sum("delta").over(w) - F.col("delta")) / (F.count("*").over(w) - 1)).alias("value"))


@register("is_target")
def is_target(c: Context) -> DataFrame:
    hit = c.targets.withColumn("hit", F.lit(1.0))
    return c.delta.join(hit, ["pert", "gene"], "left").select("pert", "gene", F.coalesce("hit", F.lit(0.0)).alias("value"))


@register("target_level")
def target_level(c: Context) -> DataFrame:
    level = c.targets.join(c.delta.select("gene", "control_mean").distinct(), "gene").groupBy("pert").agg(F.avg("control_mean").alias("value"))
    return c.delta.select("pert", "gene").join(level, "pert", "left").select("pert", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


@register("network_edge")
def network_edge(c: Context) -> DataFrame:
    """Signed edge weight from the group's targets to the measure, times the target's level."""
    level = c.delta.select(F.col("gene").alias("src"), F.col("control_mean").alias("level")).distinct()
    hit = c.targets.withColumnRenamed("gene", "src").join(c.edges, "src").join(level, "src").groupBy("pert", F.col("dst").alias("gene")).agg(F.sum(F.col("weight") * F.col("level")).alias("value"))
    return c.delta.select("pert", "gene").join(hit, ["pert", "gene"], "left").select("pert", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


@register("module_share")
def module_share(c: Context) -> DataFrame:
    """Share of the target's sets that hold the measure, times its control level."""
    own = c.targets.join(c.sets, "gene").select("pert", "set_name").distinct()
    total = own.groupBy("pert").agg(F.count("*").alias("n"))
    hit = own.join(c.sets, "set_name").groupBy("pert", "gene").agg(F.count("*").alias("k")).join(total, "pert")
    return c.delta.join(hit, ["pert", "gene"], "left").select("pert", "gene", (F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)) * F.col("control_mean")).alias("value"))


@register("response_times_level")
def response_times_level(c: Context) -> DataFrame:
    """A composed feature."""
    a, b = c.feature("mean_response"), c.feature("control_mean").withColumnRenamed("value", "level")
    return a.join(b, ["pert", "gene"]).select("pert", "gene", (F.col("value") * F.col("level")).alias("value"))
