"""Grouped sums of normalised values over a matrix that streams in, by its layout.

Every micro-batch writes its partial sums to a folder named after its number, over what an earlier attempt may have left there. So a batch
that is replayed after a failure counts once, and a stream that was stopped goes on where its checkpoint stands. The sums of all batches are added up at
the end; their size is batches x groups x measures, not cells.

Row-major input (all values of a row in one micro-batch) needs one pass. Column-major input, where a row's values are spread over
the batches, needs two: the rows' totals over all columns, then the needed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1e4


def matrix_stream(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1) -> DataFrame:
    """Files (cell, measure, cnt) of a folder as a stream of micro-batches of so many files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def partial_sums(stream: DataFrame, of_batch, keys: list[str], value: str, folder: str, before_commit=None) -> DataFrame:
    """(keys, value): of_batch(micro-batch), a table of keys and value, summed by keys over all batches there are.

    Called again with the same folder it takes up the stream where it stopped. before_commit(batch number) runs when a batch's sums are written and
    the stream does not know it yet (tests fail there).
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        sums = of_batch(batch).groupBy(*keys).agg(F.sum(value).alias(value))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        if before_commit:
            before_commit(number)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    probe = of_batch(spark.createDataFrame([], stream.schema)).select(*keys, F.col(value).cast("double").alias(value))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/sums")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return probe.limit(0)
    return spark.read.schema(probe.schema).parquet(f"{folder}/sums").groupBy(*keys).agg(F.sum(value).alias(value))


def normalised(cells: DataFrame, total) -> DataFrame:
    """x = log1p(cnt * SCALE / total); totals of 0 or less count as 1."""
    return cells.withColumn("x", F.log1p(F.col("cnt") * SCALE / F.when(total > 0, total).otherwise(F.lit(1.0))))


def grouped_sums(source, layout: str, groups: DataFrame, needed: DataFrame | None, folder: str, before_commit=None) -> DataFrame:
    """(grp, measure, x): sums of normalised values by group and measure.

    source() gives a new stream (cell, measure, cnt). layout: rows or columns. groups: (cell, grp) of the cells that count; a cell's total takes
    all its values, its sums only the needed (measure). A NULL count, and one whose logarithm does not exist, adds nothing. Call it again with the same folder after a failure.
    """
    if layout not in ("rows", "columns"):
        raise ValueError(f"{layout!r} is neither rows nor columns")

    def wanted(cells: DataFrame) -> DataFrame:
        kept = cells if needed is None else cells.join(needed.select("measure").distinct(), "measure", "left_semi")
        return kept.join(groups, "cell").select("grp", "measure", "x")

    if layout == "rows":

        def of_rows(batch: DataFrame) -> DataFrame:
            totals = batch.groupBy("cell").agg(F.sum("cnt").alias("total"))
            return wanted(normalised(batch.join(totals, "cell"), F.col("total")))

        return partial_sums(source(), of_rows, ["grp", "measure"], "x", f"{folder}/sums", before_commit)
    totals = partial_sums(source(), lambda batch: batch.select("cell", F.col("cnt").cast("double").alias("cnt")), ["cell"], "cnt", f"{folder}/totals", before_commit)
    totals = totals.withColumnRenamed("cnt", "total")
    of_columns = lambda batch: wanted(normalised(batch.join(totals, "cell"), F.col("total")))
    return partial_sums(source(), of_columns, ["grp", "measure"], "x", f"{folder}/sums", before_commit)
