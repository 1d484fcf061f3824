import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.llm.mixing import budgets, mix, take

SCHEMA = "doc_id long, text string, lang string, source string, cap long, w string"


def water(budget, children):
    """Integer water filling, child by child: {name: (cap, weight)} -> {name: share}."""
    share, open_ = {}, dict(children)
    while True:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap * total <= budget * w]
        if not full:
            break
        for k in full:
            share[k] = open_.pop(k)[0]
            budget -= share[k]
    total = sum(w for _, w in open_.values())
    return share | {k: budget * w // total for k, (_, w) in open_.items()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(4)
    weights = ({"a": 5, "b": 2}, {"x": 3}, {"s1": 4})
    leaves = {(d, l, s): rng.choice([0, 3, 50, 1000]) for d in "abc" for l in "xy" for s in ("s1", "s2", "s3")}
    got = budgets(spark.createDataFrame([(*k, v) for k, v in leaves.items()], "_domain string, _lang string, _source string, tokens long"), (2, 3), 2, weights)
    got = {(r._domain, r._lang, r._source): r.budget for r in got.collect()}

    def cap(prefix):
        return sum(2 * v for k, v in leaves.items() if k[: len(prefix)] == prefix)

    want = {}
    for d, b in water(sum(leaves.values()) * 2 // 3, {d: (cap((d,)), weights[0].get(d, 1)) for d in "abc"}).items():
        for l, c in water(b, {l: (cap((d, l)), weights[1].get(l, 1)) for l in "xy"}).items():
            for s, e in water(c, {s: (cap((d, l, s)), weights[2].get(s, 1)) for s in ("s1", "s2", "s3")}).items():
                want[d, l, s] = e
    assert got == want


def test_prefix_of_the_seeded_epochs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src7", None]), 1, "z") for k in range(600)]
    rows += [(None, "a b c", "en", "src0", 1, "z"), (7000, None, "en", "src0", 1, "z"), (7001, "w " * 50_000, "de", "src1", 1, "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = take(docs, epochs=3).select("doc_id", "_domain", F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), "_n", "_full", "_some").collect()
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for r in got:
        leaves[r._domain, r.l, r.s].append(r)
    for own in leaves.values():
        full = own[0]._full
        assert all(r._full == full for r in own)
        order = sorted(own, key=lambda r: (hashlib.sha256(f"17:{full}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id or 0))
        cut = False
        for r in order:  # whole documents, one cut, then none
            assert r._some == (0 if cut else r._some) and r._some <= r._n
            cut = cut or r._some < r._n
    total, budget = sum(r._n for r in got), sum(r._n for r in got) * 3 // 5
    taken = sum(r._full * r._n + r._some for r in got)
    assert budget - 50 <= taken <= budget and total > taken
    mixed = mix(docs, epochs=3).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == taken
    assert mixed[0].asDict().keys() == {"doc_id", "text", "lang", "source", "cap", "w"}


def test_one_epoch_repeats_no_row_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "a b c d", "en", f"src{k % 3}", 1, "z") for k in range(90)] + [(5, "a b c d", "en", "src2", 1, "z")], SCHEMA)
    got = [r.doc_id for r in mix(docs, epochs=1).collect()]
    assert len(got) - len(set(got)) <= 1
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0 and take(spark.createDataFrame([], SCHEMA)).count() == 0
