import random

from quillon.llm.line_dedup import BANDS, ROWS, dedup_lines, folded

SCHEMA = "doc_id long, text string, lid int, removed string"


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def brute(rows):
    """Union-find over all pairs of lines; the first of each component stays."""
    places = sorted({(d, n, folded(x)) for d, t, *_ in rows if d is not None for n, x in enumerate((t or "").split("\n")) if folded(x)})
    parent = list(range(len(places)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [shingles(p[2]) for p in places]
    for a in range(len(places)):
        for b in range(a + 1, len(places)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    gone = {places[a][:2] for a in range(len(places)) if find(a) != a}
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) if t is not None else None for d, t, *_ in rows]


def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgäé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bases = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(bases) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))
            if rng.random() < 0.4 and len(x) > 3:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice("xyz") + x[at + 1 :]
            lines.append(rng.choice(["", " "]) + x)
        rows.append((d + 1, "\n".join(lines + [""] * rng.randint(0, 2)), 1, "e"))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [(500 + k, f"the very same notice stands here in many of the documents of this corpus, number {k}", 1, "e") for k in range(400)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = dict(zip((r[0] for r in rows), brute(rows)))
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_lines - r.n_removed == len(r.text.split("\n")) or r.text == "" for r in got.values())


def test_odd_rows(spark):
    long = "\n".join(f"unlike line {k * 7919} {k}" for k in range(5000)) + "\n" + "z" * 200_000
    rows = [(1, None, 1, None), (2, "", 1, None), (3, "\n\n \n", 1, None), (None, "same line", 1, None), (4, "Same  line\nab\nab", 1, None), (5, "same line", 1, None), (6, long, 1, None), (5, "same line", 1, None)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lid", "removed", "n_lines", "n_removed"}
    texts = {(r.doc_id, r.text) for r in got}
    assert {(1, None), (2, ""), (3, "\n\n \n"), (None, "same line"), (4, "Same  line\nab"), (5, "")} <= texts
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_meet_pairs_at_the_threshold():
    assert 1 - (1 - 0.8**ROWS) ** BANDS >= 0.998


def test_repeated_ids_keep_their_own_lines(spark):
    a, b = "a line that both of them share in full\nonly the first text holds this", "something else stands here at the top\nonly the second text has that one"
    rows = [(5, a, 1, None), (5, b, 1, None), (6, "a line that both of them share in full\nown words of six", 1, None), (5, b, 1, None)]
    got = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([a, b, b, "own words of six"])
