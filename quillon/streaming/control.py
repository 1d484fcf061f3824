"""Keyed streaming state of the control plane: budgets, heartbeats, and resumable batches.

Rows of a key are taken in the order of time and id within a micro-batch; micro-batches come in the order of the source.
State is a few numbers a key, or a bounded list that its docstring names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budgets(calls: DataFrame, cap: float) -> DataFrame:
    """(user_id, event_id, decision, reserved, spent): each key spends under a cap of its own.

    A call with kind 'reserve' is granted if what is spent and reserved stays within the cap with it, else refused; 'settle' turns
    the oldest reservation into spending of `value` at most (the rest is free again), and is void without one.
    State: the open reservations of a key, which the cap bounds.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, held = (state.get[0], [*state.get[1]]) if state.exists else (0.0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, kind, value in zip(rows["event_id"], rows["kind"], rows["value"]):
            if kind == "reserve":
                granted = spent + sum(held) + value <= cap
                if granted:
                    held.append(float(value))
                decision = "granted" if granted else "refused"
            elif held:
                spent += min(held.pop(0), float(value))
                decision = "settled"
            else:
                decision = "void"
            out.append((key[0], event, decision, round(sum(held), 6), round(spent, 6)))
        state.update((spent, held))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "decision", "reserved", "spent"]).astype({"user_id": "int64", "event_id": "int64"})

    return calls.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, decision string, reserved double, spent double", "spent double, held array<double>", "append", GroupStateTimeout.NoTimeout)


def heartbeats(beats: DataFrame, limit_s: int) -> DataFrame:
    """(user_id, last, why): a key is put back in the queue when no beat follows its last one within the limit.

    'silent' when the watermark has passed the limit, by an event-time timer; 'late' when a beat came after it.
    State: the time of the last beat.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], pd.Timestamp(state.get[0], unit="us"), "silent"))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            times = pd.concat([b["ts"] for b in batches]).sort_values()
            for t in times.astype("datetime64[us]").astype("int64"):
                if last is not None and t - last > limit_s * 1_000_000:
                    out.append((key[0], pd.Timestamp(last, unit="us"), "late"))
                last = max(t, last or t)
            state.update((int(last),))
            due = last // 1000 + limit_s * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "last", "why"]).astype({"user_id": "int64", "last": "datetime64[us]"})

    marked = beats.withWatermark("ts", "0 seconds").select("user_id", "ts")
    return marked.groupBy("user_id").applyInPandasWithState(step, "user_id long, last timestamp, why string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def resumable(items: DataFrame, content: list[str], compute, path: str) -> DataFrame:
    """compute(items), item by item at most once for each content: results are kept under path by the hash of their content.

    Rows whose hash has a result are not computed again, so a batch that broke off goes on where it was, and changed items are
    computed anew. compute takes and returns a DataFrame and keeps the columns of its input.
    """
    spark = items.sparkSession
    keyed = items.withColumn("item", F.sha2(F.to_json(F.struct(*content)), 256))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        todo = keyed.join(spark.read.parquet(path).select("item"), "item", "left_anti")
    else:
        todo = keyed
    compute(todo.dropDuplicates(["item"])).write.mode("append").parquet(path)
    made = spark.read.parquet(path).dropDuplicates(["item"])
    return keyed.select("item").distinct().join(made, "item")
