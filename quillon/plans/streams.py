"""Streaming queries driven over the events table (ST rows). Windows, sessions and watermarks are additions of this engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.operators.graph import shared_checkpoint_dir
from quillon.streaming import events as s
from quillon.streaming import sums

from . import views as v
from .registry import query


def _events(spark, sf_dir):
    return s.read_events(spark, f"{sf_dir}/events.parquet")


@query("stream_kind_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_kind_counts(spark, sf_dir):
    """ST6."""
    return s.run_once(s.kind_counts(_events(spark, sf_dir)), "complete", shared_checkpoint_dir(spark))


@query("stream_running_best", "WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, event_id, round(value, 6) AS best FROM b WHERE before IS NULL OR value > before")
def stream_running_best(spark, sf_dir):
    """ST7."""
    return s.run_once(s.running_best(_events(spark, sf_dir)), "append", shared_checkpoint_dir(spark)).select("user_id", "event_id", v.r6("best").alias("best"))


def _matrix_files(spark, sf_dir, by: str, folder: str) -> str:
    """The lines as a matrix of orders and suppliers, in files that hold whole orders or whole suppliers."""
    line = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("measure"), F.col("l_quantity").alias("cnt"))
    line.repartition(4, by).write.mode("overwrite").parquet(f"{folder}/matrix")
    return f"{folder}/matrix"


def _streamed(spark, sf_dir, layout: str):
    folder = f"{shared_checkpoint_dir(spark)}/quillon_{uuid.uuid4().hex}"
    path = _matrix_files(spark, sf_dir, "cell" if layout == "rows" else "measure", folder)
    schema = spark.read.parquet(path).schema
    groups = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("grp")).where("grp <> '5-LOW'")
    needed = v.table(spark, sf_dir, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("measure"))
    out = sums.grouped_sums(lambda: sums.matrix_stream(spark, path, schema), layout, groups, needed, folder)
    return out.select("grp", "measure", F.round("x", 4).alias("x"))


STREAMED = "WITH t AS (SELECT l_orderkey, sum(l_quantity) AS tot FROM lineitem GROUP BY 1) SELECT o_orderpriority AS grp, l_suppkey AS measure, round(sum(ln(1 + l_quantity * 1e4 / tot)), 4) AS x FROM lineitem JOIN t USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority <> '5-LOW' AND s_nationkey < 15 GROUP BY 1, 2"


@query("stream_sums_by_rows", STREAMED)
def stream_sums_by_rows(spark, sf_dir):
    """S07, ST1: a row-major matrix streams in once; a cell's total and its needed measures come from the same micro-batch."""
    return _streamed(spark, sf_dir, "rows")


@query("stream_sums_by_columns", STREAMED)
def stream_sums_by_columns(spark, sf_dir):
    """S07, ST1: a column-major matrix streams in twice, for the cells' totals and for the needed measures."""
    return _streamed(spark, sf_dir, "columns")


@query("stream_breaker")
def stream_breaker(spark, sf_dir):
    """ST3: a keyed state machine."""
    return s.run_once(s.breaker(_events(spark, sf_dir)), "append", shared_checkpoint_dir(spark))


@query("stream_windowed_counts")
def stream_windowed_counts(spark, sf_dir):
    """Hourly windows behind a watermark: windows that the watermark has not passed yet are not out."""
    return s.run_once(s.windowed_counts(_events(spark, sf_dir)), "append", shared_checkpoint_dir(spark)).select("start", "event_type", "n", F.round("total", 4).alias("total"))
