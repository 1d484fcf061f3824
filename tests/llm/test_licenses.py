import re

from quillon.llm.licenses import BASE, TEMPLATES, postings, scan

SCHEMA = "doc_id long, text string, hits string, w int"


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in at}, 0.0
    for label, t, key in TEMPLATES:
        own, k = t.split(), key.split()
        o = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
        for start in range(-o, len(w)):
            if w[start + o : start + o + len(k)] == k:
                share = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(own)) / len(own)
                if share >= 0.6:
                    labels.add(label)
                    score = max(score, round(share, 6))
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), score)


TEXTS = [
    None, "", "   ", "MIT License", "the mit, license. MIT\nLICENSE mit license", "Apache License, Version 2.0", "license mit", "général GNU General Public License v3",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Élan MIT licence", "license", "license license mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following", "redistribution and use in source and binary forms",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "GNU Lesser General Public License", "by cc nc by", "x " * 30_000 + "apache license " + "the of " * 20_000,
    "this wor\u212a is licensed under a Creative Commons Attribution 4.0 International License", "M\u0130T license, M\u0130T mit license", "cc by nc and cc by sa license", "GNU LESSER GENERAL PUBLIC LICENSE and the mozilla public license",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; apache license",
]


def test_matches_brute_force(spark):
    rows = [(k, t, "h", 1) for k, t in enumerate(TEXTS)] + [(0, None, "h", 1), (None, "mit license", "h", 1)]
    got = scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *brute(t))) for d, t, *_ in rows)


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_words_choose_the_templates():
    idf = {w: 1.0 for _, t, _ in TEMPLATES for w in t.split()} | {"mozilla": 9.0, "the": 0.1, "license": 0.2}
    index, sizes = postings(TEMPLATES, 3, idf)
    assert ("mozilla" in index and len(index["mozilla"]) == 1) and len(sizes) == len(TEMPLATES) and all(sizes)
    for k, (_, text, key) in enumerate(TEMPLATES):
        own = [(w, at) for w, places in index.items() for t, at in places if t == k]
        assert len(own) == sizes[k] and all(text.split()[at] == w and w in key.split() for w, at in own)
