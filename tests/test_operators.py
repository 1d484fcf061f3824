import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import linear
from quillon.operators.features import REGISTRY, Context, smoke
from quillon.operators.graph import chain_root, components
from quillon.operators.joins import as_of_join, strict_one_to_one
from quillon.plans import views as v
from quillon.sources import bundles, formats

SF = "/root/testdata/sf0.001"


def test_pearson_guards(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)]
    got = dict(spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(stats.pearson(F.col("x"), F.col("y"))).collect())
    assert got == {"a": 0.0, "b": 0.0, "c": pytest.approx(1.0)}


def test_r_squared_and_mirrored(spark):
    df = spark.createDataFrame([(1.0, 1.0, -1.0), (2.0, 2.0, -2.0), (4.0, 4.0, -4.0)], "t double, p double, m double")
    row = df.agg(stats.r_squared(F.col("t"), F.col("p")), stats.pearson(F.col("t"), F.col("m")), stats.rmse(F.col("t"), F.col("p"))).head()
    assert list(row) == [pytest.approx(1.0), pytest.approx(-1.0), 0.0]


def test_normal_tail(spark):
    import math

    zs = [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_sf(F.col("z"))).collect()]
    assert all(abs(g - math.erfc(z / math.sqrt(2)) / 2) < 1e-6 for g, z in zip(got, zs))


def test_strict_join_fails_on_a_missing_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert strict_one_to_one(a.where("k = 1"), b, "k").collect()[0].b == "z"
    with pytest.raises(Exception, match="one side"):
        strict_one_to_one(a, b, "k").collect()
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    for left, right in ((twice, b.where("k = 1")), (b.where("k = 1"), twice)):
        with pytest.raises(Exception, match="more than once"):
            strict_one_to_one(left, right, "k").collect()


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 1.0)], "k string, t int, x double")
    assert {(r.k, r.t, r.x) for r in as_of_join(left, right, ["k"], "t", "x").collect()} == {("a", 5, 50.0), ("a", 1, None), ("b", 9, None)}


def test_components_and_chains(spark):
    assert dict(components(spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "a int, b int"), "a", "b").collect()) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert dict(chain_root(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "k int, p int"), "k", "p").collect()) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 2))
    y = x @ [1.5, -2.0] + 0.3 + rng.standard_normal(80) * 0.1
    row = linear.ridge_two(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "x double, z double, y double"), [], 2.0).head()
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 2 * np.eye(2), c.T @ (y - y.mean()))
    assert np.allclose([row.bx, row.bz, row.b0], [*w, y.mean() - x.mean(0) @ w])


def test_lasso_and_nnls():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 4))
    y = x @ [2.0, 0, -1.0, 0]
    g, b = x.T @ x / 200, x.T @ y / 200
    assert np.allclose(linear.lasso_weights(g, b, 0.0), [2, 0, -1, 0], atol=1e-6)
    w = linear.lasso_weights(g, b, 0.5)
    grad = b - g @ w
    assert (np.abs(grad) <= 0.5 + 1e-6).all() and np.allclose(grad[w != 0], 0.5 * np.sign(w[w != 0]))
    n = linear.nnls(g, b)
    assert (n >= 0).all() and ((g @ n - b) >= -1e-6).all()


def test_features(spark):
    from quillon.plans.features import context

    c = context(spark, SF)
    for name in REGISTRY:
        got = smoke(name, Context(c.delta, c.targets, c.edges, c.sets))
        assert got["finite"] and got["deterministic"], name


def test_text_formats(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(s,) for s in x], "value string")
    assert {tuple(r) for r in formats.gmt(lines("S\td\tA,1.0\tB\t", "short\tx")).collect()} == {("S", "A"), ("S", "B")}
    edges, aliases = formats.obo(lines("\nid: T:1\nis_a: T:0 ! x\nrelationship: part_of T:9 ! y\nalt_id: T:7\n", "\nid: T:2\nis_obsolete: true\nis_a: T:0\n", "header"))
    assert {tuple(r) for r in edges.collect()} == {("T:1", "T:0"), ("T:1", "T:9")} and [tuple(r) for r in aliases.collect()] == [("T:7", "T:1")]
    gaf = formats.gaf(lines("!c", "DB\ti\tG1\t\tGO:1\tr\tIDA", "DB\ti\tG2\tNOT|x\tGO:1\tr\tIDA", "DB\ti\tG3\t\tGO:1\tr\tIEA"), ["IDA"])
    assert [r.symbol for r in gaf.collect()] == ["G1"]
    chunks = formats.sequence_chunks(spark.createDataFrame([("c", "acgtacgtac")], "chrom string, seq string"), 4)
    ranges = spark.createDataFrame([(1, "c", 3, 6), (2, "c", -5, 2), (3, "c", 9, 99)], "id int, chrom string, start int, end int")
    assert dict(formats.fetch(chunks, ranges, 4).collect()) == {1: "GTAC", 2: "AC", 3: "AC"}
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert [tuple(r) for r in formats.delimited(spark, str(tmp_path / "t.tsv"), ["b"]).collect()] == [("2",)]
    with pytest.raises(ValueError, match="lacks"):
        formats.delimited(spark, str(tmp_path / "t.tsv"), ["z"])


def test_zip_reader(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "one\ntwo")
    assert formats.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "x.zip"))).head().value == "one\ntwo"


def test_bundle_round_trip(spark, tmp_path):
    profiles = v.profiles(v.normalised(v.counts(spark, SF))).select("pert", "gene", "mean")
    part = F.when(F.col("pert") % 5 < 3, "train").when(F.col("pert") % 5 == 3, "val1").otherwise("val2")
    split = profiles.select("pert").distinct().withColumn("part", part)
    path = str(tmp_path / "b")
    assert bundles.write_bundle(profiles, split, path).count() == 3
    assert bundles.verify_bundle(spark, path).isEmpty()
    bundles.export_public(spark, path, str(tmp_path / "pub"))
    assert spark.read.parquet(str(tmp_path / "pub/profiles")).where("pert % 5 > 2").isEmpty()
    with pytest.raises(ValueError, match="empty"):
        bundles.write_bundle(profiles, split.where("part <> 'val2'"), str(tmp_path / "c"))


def test_package_detects_changes(spark, tmp_path):
    coef = spark.createDataFrame([("m", "x", 0.0, 1.0, 2.0)], "member string, column string, mean double, scale double, coef double")
    path = str(tmp_path / "p")
    bundles.write_package(coef, path)
    assert bundles.load_package(spark, path).count() == 1
    coef.withColumn("coef", F.lit(3.0)).write.mode("overwrite").parquet(f"{path}/coefficients")
    with pytest.raises(ValueError, match="changed"):
        bundles.load_package(spark, path)


def test_layers():
    assert bundles.layered({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}, "d": 3}


def test_student_t():
    from quillon.operators.inference import t_quantile, t_two_sided

    # Known table values.
    for df, q in ((1, 12.7062), (4, 2.7764), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        assert abs(t_quantile(0.975, df) - q) < 1e-3
        assert abs(t_two_sided(q, df) - 0.05) < 1e-4


def test_welch_and_arm_rule(spark):
    from quillon.operators.inference import arm_rule, welch

    rows = [("k", "a", 1.0), ("k", "a", 2.0), ("k", "a", 3.0), ("k", "b", 4.0), ("k", "b", 6.0), ("k", "b", 8.0), ("few", "a", 1.0), ("few", "b", 2.0)]
    got = {r.k: r for r in welch(spark.createDataFrame(rows, "k string, s string, x double"), "k", "s", "x").collect()}
    assert abs(got["k"].t + 3.098387) < 1e-5 and abs(got["k"].df - 2.941176) < 1e-5 and 0.053 < got["k"].p < 0.057
    assert got["few"].p is None
    runs = [("good", 0.5, 0.05, 20, 5, 25), ("good", 0.6, 0.05, 19, 6, 25), ("bad", -0.5, 0.05, 3, 22, 25), ("none", 0.1, 0.2, 13, 12, 25)]
    out = {r.arm: r.verdict for r in arm_rule(spark.createDataFrame(runs, "arm string, g double, s double, wins_a int, wins_b int, pairs int"), "arm", 25).collect()}
    assert out == {"good": "a", "bad": "b", "none": "none"}
