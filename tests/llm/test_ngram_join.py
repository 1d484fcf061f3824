import random

from quillon.llm.ngram_join import near_duplicates, one_of_each_group, recall_at

SCHEMA = "doc_id long, text string, cls int"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] is not None and sets[b][0] is not None and x and y and len(x & y) >= threshold * len(x | y):
                links[a].add(b)
                links[b].add(a)
    return links


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows) + 1, " ".join(text), k))
    return rows


def test_links_match_brute_force(spark):
    rows = corpus()
    # all of one very large bucket: more members than a block holds
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split() * 4
    rows += [(1000 + k, " ".join([*base, f"tail{k}"]), 0) for k in range(600)]
    want = brute(rows)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    lost = sum(got[rows[k][0]].n_links != len(v) for k, v in want.items())
    assert lost == 0
    for k, v in want.items():
        me = got[rows[k][0]]
        assert all(got[rows[o][0]].component_id == me.component_id for o in v)
        assert me.kept == (me.component_id == me.doc_id)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None, 1), (2, "", 1), (3, "  ", 1), (None, "same words here", 1), (4, "same words here", 1), (5, "Same  words\nhere", 1), (6, long, 1), (7, long + " end", 1), (8, "x y", 1), (8, "x y", 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[4].class_id, by[4].n_links, by[5].class_id, by[5].kept) == (4, 1, 4, False)
    assert (by[7].component_id, by[7].n_links, by[8].n_links) == (6, 1, 1)
    assert [by[k].n_links for k in (1, 2, 3, None)] == [0] * 4
    left = one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 3, 4, 6, 8]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_bound():
    assert recall_at(0.8, 5) > 0.995 > recall_at(0.8, 6)


def near_threshold(n):
    """Pairs of similarities from just above the threshold to almost 1."""
    rng = random.Random(12)
    rows = []
    for k in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        other = list(base)
        for at in rng.sample(range(2, 148), rng.randint(1, 4)):
            other[at] = f"x{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(base), 0), (2 * k + 1, " ".join(other), 0)]
    return rows


def test_prefixes_are_shortened_until_the_target(spark):
    rows = near_threshold(150)
    want = brute(rows)
    levels = []
    got = {r.doc_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), trees=6, target=0.9, levels=levels).collect()}
    depths = [d for d, _, _ in levels]
    assert len(levels) >= 2 and depths == sorted(depths, reverse=True) and depths[0] == 8 and depths[-1] <= 6
    assert levels[0][1] > 0 and len({n for _, n, _ in levels}) > 1 and levels[0][2] < 0.9 <= levels[-1][2]
    assert sum(n for _, n, _ in levels) == sum(got.values()) / 2 and sum(got.values()) > 0.9 * sum(map(len, want.values()))
    assert all(got[rows[k][0]] <= len(v) for k, v in want.items())


def test_whole_signatures_can_be_enough(spark):
    rows = [(k, " ".join(f"w{k // 2}-{i}" for i in range(300)) + (" end" if k % 2 else ""), 0) for k in range(60)]
    levels = []
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), trees=16, target=0.9, levels=levels).collect()
    assert all(r.n_links == 1 for r in got) and [d for d, _, _ in levels] == [8]


def test_repeated_ids_keep_their_own_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(9, a, 1), (9, b, 1), (3, a + " more", 1), (9, b, 1), (10, "", 1), (10, "", 1)]
    left = one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(3, a + " more"), (9, b), (10, ""), (10, "")])
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id) for r in got) == [(3, 1, 3), (9, 1, 3), (9, 1, 9), (9, 1, 9), (10, 0, 10), (10, 0, 10)]
