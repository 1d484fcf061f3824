"""Structured Streaming counterparts of the ordered ledger operators.

Each takes a streaming DataFrame of events (event_id, ts, user_id, event_type, value) and
returns a streaming DataFrame; run_once() drives one over the rows that are there.

Rows of a key are put in the order of time and id within a micro-batch, and a micro-batch's rows of one key are held by one
task: bound micro-batches (maxFilesPerTrigger) where a key may be hot. Rows that come late in a later micro-batch are taken when
they come. State of a key is a few numbers and has no timeout, as a key's best value and its breaker do not expire.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream, with its own schema."""
    schema = spark.read.parquet(path).schema
    if _is_file(spark, path):  # a stream reads folders: the file is picked by its name
        folder, _, name = path.rpartition("/")
        stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    else:
        stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", stream["ts"].cast("timestamp"))  # event time needs an instant


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def windowed_counts(events: DataFrame) -> DataFrame:
    """Counts and sums by type over hourly windows, late rows dropped after two hours."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", "2 hours").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def kind_counts(events: DataFrame) -> DataFrame:
    """Running counts by kind (complete mode)."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of a user: rows closer than the gap."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def running_best(events: DataFrame) -> DataFrame:
    """A row whenever a user's best value rises, from keyed state."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, value in zip(rows["event_id"], rows["value"]):
            if value > best:
                best = value
                out.append((key[0], event, value))
        state.update((best,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "best"]).astype({"user_id": "int64", "event_id": "int64", "best": "float64"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, best double", "best double", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, failures: int = 5, window_s: int = 7200, cooldown_s: int = 3600) -> DataFrame:
    """Circuit breaker by user: opens after so many low values in a sliding window; each time it opens the cooldown doubles."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, until, wait = ([*state.get[0]], state.get[1], state.get[2]) if state.exists else ([], 0.0, float(cooldown_s))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, value in zip(rows["event_id"], rows["ts"], rows["value"]):
            t = ts.timestamp()
            if t < until:
                out.append((key[0], event, "open"))
                continue
            recent = [x for x in recent if x >= t - window_s]
            if value < 20:
                recent.append(t)
                if len(recent) >= failures:
                    until, wait, recent = t + wait, wait * 2, []
                    out.append((key[0], event, "opens"))
                    continue
            else:
                wait = float(cooldown_s) if not recent else wait
            out.append((key[0], event, "closed"))
        state.update((recent, until, wait))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"]).astype({"user_id": "int64", "event_id": "int64"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "recent array<double>, until double, wait double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drive a stream over the rows that are there and return what it wrote.

    Append streams write Parquet under folder; complete ones, whose result is small, a table in memory.
    """
    spark, name = stream.sparkSession, f"quillon_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}/checkpoint")
    if mode == "append":
        writer.format("parquet").start(f"{folder}/{name}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/{name}/out")
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)
