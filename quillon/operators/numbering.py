"""Numbers and runs over whole tables of integer keys, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a block. One task sorts one block; the list of blocks is as much smaller than the table.
BLOCK = 100_000


def numbered(df: DataFrame, key: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the row's number from 1 by an integer key without repetitions: its rank in its block after the blocks before."""
    rows = df.withColumn("_block", F.floor(F.col(key) / block))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")).alias("_before"))  # a row a block
    own = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return rows.withColumn("_own", own).join(before, "_block").withColumn(name, F.col("_before") + F.col("_own")).drop("_block", "_before", "_own")


def runs(df: DataFrame, groups: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """(groups, first, last, n): maximal runs of consecutive integer keys in each group; keys do not repeat.

    Runs are found within blocks of keys; only those that touch a block's edge are joined with their neighbours.
    """
    rows = df.select(*groups, F.col(key).alias("_k"), F.floor(F.col(key) / block).alias("_block"))
    island = F.col("_k") - F.row_number().over(Window.partitionBy(*groups, "_block").orderBy("_k"))
    parts = rows.withColumn("_island", island).groupBy(*groups, "_block", "_island").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("n"))
    edge = (F.col("first") == F.col("_block") * block) | (F.col("last") == (F.col("_block") + 1) * block - 1)
    inner = parts.where(~edge).select(*groups, "first", "last", "n")
    # Two rows a block and group at most.
    order = Window.partitionBy(*groups).orderBy("first")
    opens = F.when(F.coalesce(F.lag("last").over(order) + 1 == F.col("first"), F.lit(False)), 0).otherwise(1)
    outer = parts.where(edge).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order)).groupBy(*groups, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return inner.unionByName(outer.drop("_run"))


#: Parts into which the values of a group are cut before they are ranked, and the accuracy of the cuts (they need not be even).
CUTS, ACCURACY = 64, 2000


def _blocked(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """df with _block: how many of CUTS - 1 approximate quantiles of its group lie below the value. Any cuts give right ranks; even ones give even tasks."""
    shares = F.array(*(F.lit(k / CUTS) for k in range(1, CUTS)))
    cuts = df.groupBy(*groups).agg(F.percentile_approx(value, shares, ACCURACY).alias("_cuts"))
    return df.join(cuts, groups).withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def _before(rows: DataFrame, groups: list[str], sums: dict) -> DataFrame:
    """Totals of the blocks before each block: CUTS rows a group at most."""
    order = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, "_block").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    return totals.select(*groups, "_block", *(F.coalesce(F.sum(f"_t_{c}").over(order), F.lit(0)).alias(f"_b_{c}") for c in sums))


def value_ranks(df: DataFrame, groups: list[str], value: str, **sums: Column) -> DataFrame:
    """(groups, value, n, mid, sums, sums_upto): each different value of a group once, with its rows, their average rank, and each
    sum over its rows and over all rows up to it. NULL values are left out.

    Equal values are counted before anything is ordered, and a task orders a part of a group.
    """
    sums = {"n": F.lit(1).cast("long")} | sums
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*(F.sum(e).alias(c) for c, e in sums.items()))
    rows = _blocked(counted, groups, value)
    upto = Window.partitionBy(*groups, "_block").orderBy(value)
    rows = rows.join(_before(rows, groups, sums), [*groups, "_block"]).withColumns({f"{c}_upto": F.col(f"_b_{c}") + F.sum(c).over(upto) for c in sums})
    mid = F.col("n_upto") - (F.col("n") - 1) / 2
    return rows.withColumn("mid", mid).drop("_block", *(f"_b_{c}" for c in sums))


def row_ranks(df: DataFrame, groups: list[str], value: str, tie: str, name: str) -> DataFrame:
    """df with the row's number from 1 in its group by value and then tie, which does not repeat; a task orders a part of a group."""
    rows = _blocked(df, groups, value).withColumn("_one", F.lit(1).cast("long"))
    own = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy(value, tie))
    return rows.withColumn("_own", own).join(_before(rows, groups, {"_one": None}), [*groups, "_block"]).withColumn(name, F.col("_b__one") + F.col("_own")).drop("_block", "_one", "_own", "_b__one")


def running_total(df: DataFrame, groups: list[str], key: str, tie: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over its group up to the row, in the order of an integer key and tie; a task orders a block of keys."""
    rows = df.withColumn("_block", F.floor(F.col(key) / block)).withColumn("_x", value)
    before = _before(rows, groups, {"_x": None})
    own = F.sum("_x").over(Window.partitionBy(*groups, "_block").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, [*groups, "_block"]).withColumn(name, F.col("_b__x") + F.col("_own")).drop("_block", "_x", "_own", "_b__x")


def hash_ranks(df: DataFrame, groups: list[str], order: Column, name: str) -> DataFrame:
    """df with the row's number from 1 in its group by a hexadecimal hash, which does not repeat; a task orders the rows of one group whose hashes begin alike."""
    rows = df.withColumn("_h", order).withColumn("_block", F.substring("_h", 1, 2)).withColumn("_one", F.lit(1).cast("long"))
    own = F.row_number().over(Window.partitionBy(*groups, "_block").orderBy("_h"))
    return rows.withColumn("_own", own).join(_before(rows, groups, {"_one": None}), [*groups, "_block"]).withColumn(name, F.col("_b__one") + F.col("_own")).drop("_h", "_block", "_one", "_own", "_b__one")


def chunk_plan(df: DataFrame, groups: list[str], key: str, size: str, most_items: int, most_size: int, block: int = BLOCK) -> DataFrame:
    """(groups, chunk, first, last, n, size): each group's rows, in the order of an integer key that does not repeat in it, cut greedily into chunks of at most
    most_items rows whose sizes add up to at most most_size; a chunk holds at least one row, however large. Chunks are numbered from 0.

    Every row points to the row that would begin the next chunk if it began one. It is found in blocks of rows that also hold the first rows of
    the block after them. The rows that do begin chunks are those that the pointers lead to from a group's first row: in each round the marked
    rows mark those a jump ahead, and the jumps double. Sizes are integers; NULL and negative sizes count as 0.
    """
    from .graph import cut

    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(*groups, F.col(key).cast("long").alias("_k"), whole.alias("_size"))
    rows = running_total(rows, groups, "_k", "_k", F.lit(1).cast("long"), "_n", block)
    rows = running_total(rows, groups, "_k", "_k", F.col("_size"), "_upto", block)
    rows = cut(rows.select(*groups, (F.col("_n") - 1).alias("_i"), "_k", (F.col("_upto") - F.col("_size")).alias("_p"), "_upto"))
    ends = rows.groupBy(*groups).agg((F.max("_i") + 1).alias("_i"), F.lit(None).cast("long").alias("_k"), F.max("_upto").alias("_p"))
    every = rows.drop("_upto").unionByName(ends)
    step = max(block, most_items)
    own = F.floor(F.col("_i") / step)
    near = every.withColumn("_b", F.explode(F.when((F.col("_i") % step < most_items) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    reach = F.max("_i").over(Window.partitionBy(*groups, "_b").orderBy("_p").rangeBetween(0, most_size))
    jump = near.withColumn("_far", reach).where(own == F.col("_b")).where("_k is not null")
    jump = cut(jump.select(*groups, "_i", F.greatest(F.col("_i") + 1, F.least(F.col("_i") + most_items, "_far")).alias("_to")))
    after = jump
    marked = cut(rows.where("_i = 0").select(*groups, "_i"))
    while True:
        fresh = cut(marked.join(jump, [*groups, "_i"]).select(*groups, F.col("_to").alias("_i")).join(marked, [*groups, "_i"], "left_anti").join(rows.select(*groups, "_i"), [*groups, "_i"], "left_semi"))
        if fresh.isEmpty():
            break
        marked = cut(marked.union(fresh))
        jump = cut(jump.join(jump.select(*groups, F.col("_i").alias("_to"), F.col("_to").alias("_next")), [*groups, "_to"]).select(*groups, "_i", F.col("_next").alias("_to")))
    starts = marked.join(after, [*groups, "_i"]).join(rows.select(*groups, "_i", F.col("_k").alias("first"), "_p"), [*groups, "_i"])
    last = rows.select(*groups, (F.col("_i") + 1).alias("_to"), F.col("_k").alias("last"), "_upto")
    out = starts.join(last, [*groups, "_to"]).select(*groups, "_i", "first", "last", (F.col("_to") - F.col("_i")).alias("n"), (F.col("_upto") - F.col("_p")).alias("size"))
    return running_total(out, groups, "_i", "_i", F.lit(1).cast("long"), "_c", block).select(*groups, (F.col("_c") - 1).alias("chunk"), "first", "last", "n", "size")
