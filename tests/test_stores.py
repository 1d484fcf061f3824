"""Ledgers, exports, plugin checks, reports and control streams against plain Python."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import plugins
from quillon.operators.neighbours import cosine_neighbours
from quillon.plans import views as v
from quillon.plans.stores import SOURCES
from quillon.sources import bundles, matrices, reports
from quillon.sources.store import VersionedTable
from quillon.streaming import control
from quillon.streaming import events as s

SF = "/root/testdata/sf0.001"


def test_versions_and_claims(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "q"), "id")
    rows = [(k, k % 3, 100 - k, "queued", None) for k in range(12)]
    assert t.update(lambda _: spark.createDataFrame(rows, "id int, priority int, created int, status string, worker string").coalesce(1)) == 1
    assert not t.commit(spark.createDataFrame([], t.read().schema), 0)  # version 1 is there
    got, errors = [], []

    def work(name):
        try:
            while (k := t.claim(name, [F.desc("priority"), "created"])) is not None:
                got.append((k, name))
        except Exception as e:  # noqa: BLE001  a thread's failure must reach the test
            errors.append(e)

    threads = [threading.Thread(target=work, args=(f"w{k}",)) for k in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and sorted(k for k, _ in got) == list(range(12))
    assert {(r.id, r.worker) for r in t.read().collect()} == set(got)
    assert sorted(t.versions()) == list(range(1, 14))
    assert t.read(1).where("status = 'queued'").count() == 12 and t.read(2).where("status = 'queued'").count() == 11
    first = t.read(2).where("status = 'claimed'").head()
    assert (first.priority, first.created) == (2, min(100 - k for k in range(12) if k % 3 == 2))


def test_public_export_is_whole_or_absent(spark, tmp_path):
    profiles = v.profiles(v.normalised(v.counts(spark, SF))).select("pert", "gene", "mean")
    split = profiles.select("pert").distinct().withColumn("part", F.when(F.col("pert") % 5 < 3, "train").when(F.col("pert") % 5 == 3, "val1").otherwise("val2"))
    path, dest = str(tmp_path / "b"), str(tmp_path / "pub")
    bundles.write_bundle(profiles, split, path)
    assert [bundles.export_public(spark, path, dest) for _ in range(2)] == ["written", "unchanged"]
    bundles.write_bundle(profiles.withColumn("mean", F.col("mean") + 1), split, path)
    assert bundles.export_public(spark, path, dest) == "written"
    assert {p.name for p in tmp_path.iterdir()} == {"b", "pub"}
    assert spark.read.parquet(f"{dest}/profiles").agg(F.min("mean")).head()[0] >= 1
    with pytest.raises(ValueError, match="profiles"):
        bundles.export_public(spark, str(tmp_path / "none"), dest)


def test_plugin_problems():
    for k, (source, problems) in enumerate(SOURCES):
        assert ",".join(plugins.problems_of(source.replace("{0}", "5"), "f5")) == problems, k
    good = "'''words'''\nimport numpy as np\nLIMIT: int = 3\n@register('a')\nclass A:\n    def compute(self, c):\n        return sorted(c)\n"
    assert plugins.problems_of(good, "a") == []
    assert plugins.problems_of(good, "b") == ["registration"]
    assert plugins.problems_of(good + "from numpy import load\n", "a") == ["attribute"]
    assert plugins.problems_of(good + "from . import x\n", "a") == ["import"]
    assert plugins.problems_of(good + "x = 4294967296\n", "a") == ["literal"]
    assert plugins.problems_of(good + "x = '" + "y" * 3000 + "'\n", "a") == ["literal"]
    assert plugins.problems_of(good + "x = id(LIMIT)\n", "a") == ["name"]
    assert plugins.problems_of("x = " + "(" * 5000, "a") == ["syntax"]


def test_plan_shows_what_is_read(spark):
    seen = plugins.reads(v.table(spark, SF, "orders").where("o_orderkey > 5").select("o_custkey"))
    assert seen == {"orders.parquet": {"o_orderkey", "o_custkey"}}
    rows = catalog.queries()["label_reads"](spark, SF).collect()
    assert {r.table for r in rows if r.feature == "control_mean"} >= {"lineitem.parquet", "orders.parquet"}


def test_report_twins(spark):
    df = spark.createDataFrame([("b|x", 1.0, None), ("a", 0.12345, 2)], "k string, x double, n int")
    text, twin = reports.write(df, "T", ["k"])
    assert text == "# T\n\n| k | x | n |\n|---|---|---|\n| a | 0.1235 | 2 |\n| b\\|x | 1.0000 | - |\n" and reports.render(twin) == text
    with pytest.raises(ValueError, match="at most"):
        reports.rows_of(spark.range(20), ["id"], most=5)


def test_matrix_layouts(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0), (2, "a", 5.0)], "r int, c string, x double")
    dense = spark.createDataFrame([(1, 2.0, 0.0), (2, 5.0, None)], "r int, a double, b double")
    vector = spark.createDataFrame([(1, [2.0, 0.0]), (2, [5.0, None])], "r int, x array<double>")
    assert [matrices.layout(df, "r") for df in (long, dense, vector)] == ["long", "dense", "vector"]
    assert [sorted(map(tuple, matrices.to_long(df, "r").collect())) for df in (long, dense)] == [[(1, "a", 2.0), (2, "a", 5.0)]] * 2
    assert sorted(map(tuple, matrices.to_long(vector, "r").collect())) == [(1, "0", 2.0), (2, "0", 5.0)]
    with pytest.raises(ValueError, match="layout"):
        matrices.layout(spark.createDataFrame([(1, "a")], "r int, a string"), "r")


def test_cosine_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5))
    x[7] = x[3]
    rows = [(k, a.tolist()) for k, a in enumerate(x)] + [(100, [0.0] * 5), (101, None), (102, [1.0, float("nan"), 0.0, 0.0, 0.0])]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T
    want = {(a, b) for a in range(60) for b in sorted((b for b in range(60) if b != a), key=lambda b: (-round(near[a, b], 12), b))[:4]}
    got = {(r.a, r.b) for r in cosine_neighbours(spark.createDataFrame(rows, "id int, x array<double>"), 4, block=13).collect()}
    assert got == want


def stream(spark, tmp_path, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_budgets(spark, tmp_path):
    calls = [[(1, 1, at(0), "reserve", 60.0), (1, 2, at(1), "reserve", 50.0), (2, 3, at(1), "settle", 5.0)], [(1, 4, at(2), "settle", 10.0), (1, 5, at(3), "reserve", 50.0), (1, 6, at(4), "settle", 99.0)]]
    got = s.run_once(control.budgets(stream(spark, tmp_path, calls, "user_id long, event_id long, ts timestamp, kind string, value double"), 100.0), "append", str(tmp_path))
    assert {r.event_id: (r.decision, r.reserved, r.spent) for r in got.collect()} == {1: ("granted", 60, 0), 2: ("refused", 60, 0), 3: ("void", 0, 0), 4: ("settled", 0, 10), 5: ("granted", 50, 10), 6: ("settled", 0, 60)}


def test_budgets_on_the_events(spark):
    rows = v.table(spark, SF, "events").where("event_type in ('purchase', 'click')").orderBy("user_id", "ts", "event_id").collect()
    want, user = {}, None
    for r in rows:
        if r.user_id != user:
            user, spent, held = r.user_id, 0.0, []
        if r.event_type == "purchase":
            ok = spent + sum(held) + r.value <= 200
            held += [r.value] * ok
            said = "granted" if ok else "refused"
        else:
            said = "settled" if held else "void"
            spent += min(held.pop(0), r.value) if held else 0
        want[r.event_id] = (said, round(sum(held), 4), round(spent, 4))
    got = catalog.queries()["stream_budgets"](spark, SF).collect()
    assert {r.event_id: (r.decision, round(r.reserved, 4), round(r.spent, 4)) for r in got} == want


def test_heartbeats_over_batches(spark, tmp_path):
    beats = [[(1, at(0)), (2, at(0)), (3, at(0))], [(1, at(20)), (3, at(90))], [(1, at(40)), (3, at(100))]]
    got = s.run_once(control.heartbeats(stream(spark, tmp_path, beats, "user_id long, ts timestamp"), 1800), "append", str(tmp_path))
    rows = sorted((r.user_id, r.last, r.why) for r in got.collect())
    # 2 stops; 3 beats again an hour late; 1 has been silent for an hour when 3 beats at the end.
    assert [(u, why) for u, _, why in rows] == [(1, "silent"), (2, "silent"), (3, "late")]


def test_resumable_computes_each_item_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string")
    done = spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for b in batches:
                done.add(len(b))
                yield b[["item"]].assign(size=b["text"].str.len())

        return df.mapInPandas(run, "item string, size long")

    path = str(tmp_path / "r")
    assert control.resumable(items.where("id = 1"), ["text"], compute, path).count() == 1
    assert control.resumable(items, ["text"], compute, path).count() == 2 and done.value == 2
    assert control.resumable(items, ["text"], compute, path).count() == 2 and done.value == 2
