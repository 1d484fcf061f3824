import random
from collections import Counter

import corpus_pipeline as pipeline
from quillon.llm.quality import score_documents, train
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_links
from tests.llm.test_packing import check as check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    made = [docs]
    for k, (_, f) in enumerate(pipeline.STAGES, 1):
        f(spark, made[-1], SF).write.parquet(str(tmp_path / str(k)))
        made.append(spark.read.parquet(str(tmp_path / str(k))))
    start, kept, lines, groups, mixed, packed = made
    assert all(m.columns == docs.columns for m in made[:-1])

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = score_documents(start, train(start, labels)).collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores if r.score >= 0.5}

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id: r.text for r in lines.collect()} == dict(zip((d for d, _ in rows), brute_lines(rows)))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    links, seen, stay = brute_links(rows), set(), []
    for k in range(len(rows)):
        if k not in seen:
            stay.append(rows[k][0])
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    assert sorted(r.doc_id for r in groups.collect()) == stay

    before = {r.doc_id: r.text for r in groups.collect()}
    total = sum(len(t.split()) for t in before.values())
    after = [(r.doc_id, r.text) for r in mixed.collect()]
    assert len({d for d, _ in after}) == len(after) and all(before[d].lstrip().startswith(t.strip()) for d, t in after)
    assert total * 4 // 5 - 60 <= sum(len(t.split()) for _, t in after) <= total * 4 // 5
    check_packing(after, packed.collect())


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    got = pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


def odd_corpus():
    """Null and empty texts, null ids and sources, repeated rows and ids, one very long text, good and bad prose."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows, labels = [], []
    for k in range(200):
        good = k % 3 > 0
        text = "\n".join(say(rng.randint(8, 40)) for _ in range(3)) if good else say(60).upper().replace(" ", "!! ")
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), len(text)))
        labels.append((k, int(good), 0))
    a, b = say(50), say(50)
    rows += [(300, None, "en", "src0", None), (301, "", "en", "src0", 0), (None, say(30), "en", "src1", 1), (302, a, "en", "src0", 1), (302, a, "en", "src0", 1), (302, b, "en", "src0", 1), (303, "\n".join(say(40) for _ in range(700)), "en", "src0", 1)]
    return rows, labels, a, b


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use inside.
CLASHING = ["lid", "key", "cls", "sig", "weight", "_salt", "_id", "_row", "_doc", "_lost", "_n", "_domain", "component", "rows", "score", "removed", "length", "sequence_id", "txt", "stays"]


def test_odd_rows_in_every_stage(spark, tmp_path):
    rows, labels, a, b = odd_corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", *(f"7 as {c}" for c in CLASHING))
    made = []
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / str(k)))
        made.append(spark.read.parquet(str(tmp_path / str(k))))
        if k == 1:  # as a stage of its own: the rows that the classifier may reject come back
            docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", *(f"7 as {c}" for c in CLASHING))
        elif k < len(pipeline.STAGES) - 1:
            assert made[-1].columns == docs.columns
    kept, lines, groups, mixed, packed = made
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200} == {k for k in range(200) if k % 3}
    assert lines.where("text is null").count() <= 1
    left = Counter((r.doc_id, r.text) for r in groups.collect())
    assert left[302, a] == left[302, b] == left[300, None] == left[301, ""] == 1 and sum(n for (d, _), n in left.items() if d is None) == 1
    assert all(r.text for r in mixed.collect())
    assert packed.count() > 0 and packed.where("sequence_id is null").count() == 0


def test_empty_tables_in_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], FIELDS)
    for name, f in pipeline.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0, name
