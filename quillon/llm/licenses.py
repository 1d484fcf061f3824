"""License scans with a positional rare-token index (operator 6), in DataFrame operations only.

Every text is lower-cased and cut into words. A staged table keeps, of each text, the words of the licence vocabulary
with their positions. Inverse document frequencies of that vocabulary are counted over all texts. The index has a
posting (word, template, position) for each of the RARE rarest words of a template's mandatory key phrase. Of each file its
highest-IDF licence words, down to the commonest word that has a posting, are looked up there; every posting names
the place where its template would start, and places on which all of a template's postings agree are candidates.
Templates none of whose rare words a file holds are never looked at. At a candidate the whole key
phrase is verified, and the share of the template's words that stand in place must reach LEAST.

The key phrases contain the base phrases, so the method's labels include the base labels.

Defined cases: a null text is an empty one (no words, no labels, score 0). Null ids and repeated rows give their own
rows. An empty table gives none. Letters beyond A-Z are no part of a licence word: the two that lower-case to an
ASCII letter (the kelvin sign and the dotted capital I) are replaced before the text is lower-cased. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stage, table

#: The words of a text, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The letters beyond ASCII whose lower case holds an ASCII letter.
LIKE_ASCII = ["\u212a", "\u0130"]
#: Label, template, mandatory key phrase (a part of the template).
TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "not use this file except in compliance"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
]
RARE, LEAST = 3, 0.6


def _words(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    for letter in LIKE_ASCII:
        own = F.replace(own, F.lit(letter), F.lit("ÿ"))
    return F.regexp_extract_all(F.lower(own), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _starts(words: Column, ends: Column, phrase: str) -> Column:
    """Start positions of a phrase, given the positions of its last word."""
    parts = phrase.split()
    n = len(parts)

    def stands(i):
        test = i >= n - 1
        for back, w in enumerate(reversed(parts[:-1]), 1):
            test = test & (F.get(words, i - back) == w)
        return test

    return F.transform(F.filter(ends, lambda i: F.coalesce(stands(i), F.lit(False))), lambda i: i - (n - 1))


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = RARE, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs (doc_id, text)."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    # Without the last word of a key phrase no template can be met; most texts end here.
    anchors = sorted({k.split()[-1] for _, _, k in templates})
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("w"))
    n = F.size("w")
    places = lambda keep: F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: keep(F.get("w", i)))
    none = F.array().cast("array<int>")
    words = lowered.select("doc_id", "w", n.cast("long").alias("n_words"), F.arrays_overlap("w", _strings(anchors)).alias("met"))
    words = words.withColumn("ends", F.when(F.array_contains("w", "license"), places(lambda x: x == "license")).otherwise(none))
    base = {phrase: _starts(F.col("w"), F.col("ends"), phrase) for phrase in BASE}
    hits = F.when(F.col("met"), F.transform(places(lambda x: x.isin(vocabulary)), lambda i: F.struct(F.get("w", i).alias("w"), i.alias("p"))))
    seen = words.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "n_words",
        *(s.alias(f"b{k}") for k, s in enumerate(base.values())),
        F.coalesce(hits, F.array().cast("array<struct<w:string,p:int>>")).alias("hits"),
        # Which words of the vocabulary it holds, for the document frequencies.
        F.array_intersect("w", _strings(vocabulary)).alias("kinds"),
    )
    seen = stage(seen, "op6-words")
    total = seen.count()
    frequency = {r.w: r.n for r in seen.select(F.explode("kinds").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # the vocabulary's words at most
    idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary}
    found = _templates(seen.where(F.size("hits") > 0).select("rid", "hits"), templates, rare, least, idf)
    starts = F.concat(*(F.col(f"b{k}") for k in range(len(BASE))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values()))))
    joined = seen.drop("hits", "kinds").join(found, "rid", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def postings(templates, rare: int, idf: dict[str, float]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """The index: word -> (template, position) of the rarest key words; and how many postings each template has."""
    index, sizes = {}, []
    for k, (_, text, key) in enumerate(templates):
        own, phrase = text.split(), key.split()
        at = _key_at(own, phrase)
        chosen = sorted(set(phrase), key=lambda w: (-idf[w], w))[:rare]
        places = [i for i in range(at, at + len(phrase)) if own[i] in chosen]
        for i in places:
            index.setdefault(own[i], []).append((k, i))
        sizes.append(len(places))
    return index, sizes


def _key_at(own: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)


def _templates(rows: DataFrame, templates, rare: int, least: float, idf: dict[str, float]) -> DataFrame:
    """(rid, more array<string>, score) of the rows in which a template is found."""
    index, sizes = postings(templates, rare, idf)
    pairs = [c for w, own in sorted(index.items()) for c in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for t, i in own)))]
    lookup = F.create_map(*pairs)
    # The file's rare words: those that have postings.
    found = F.filter("hits", lambda h: h["w"].isin(sorted(index)))
    votes = F.flatten(F.transform(found, lambda h: F.transform(F.element_at(lookup, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["p"] - p["at"]).alias("start")))))
    voted = rows.select("rid", F.explode(votes).alias("v")).select("rid", "v.t", "v.start")
    need = F.array(*(F.lit(n) for n in sizes))
    agreed = voted.groupBy("rid", "t", "start").agg(F.count("*").alias("n")).where(F.col("n") == F.get(need, F.col("t")))
    entries = []
    for label, text, key in templates:
        own, phrase = text.split(), key.split()
        entries.append(F.struct(F.lit(label).alias("label"), _strings(own).alias("own"), F.lit(_key_at(own, phrase)).alias("key_at"), F.lit(len(phrase)).alias("key_n")))
    places = rows.join(agreed, "rid").select("rid", "hits", F.get(F.array(*entries), F.col("t")).alias("t"), "start")
    stands = lambda i: F.array_contains("hits", F.struct(F.get("t.own", i).alias("w"), (F.col("start") + i).alias("p")))
    key = F.forall(F.sequence("t.key_at", F.col("t.key_at") + F.col("t.key_n") - 1), stands)
    share = F.size(F.filter(F.sequence(F.lit(0), F.size("t.own") - 1), stands)) / F.size("t.own")
    scored = places.where(key).select("rid", "t.label", share.cast("double").alias("share")).where(F.col("share") >= least)
    return scored.groupBy("rid").agg(F.collect_set("label").alias("more"), F.round(F.max("share"), 6).alias("score"))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def license_sql(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same result in SQL, by matching every template at every place."""
    rows = []
    for k, (label, text, key) in enumerate(templates):
        own, phrase = text.split(), key.split()
        at = _key_at(own, phrase)
        rows += [f"({k}, '{label}', {i}, '{w}', {str(at <= i < at + len(phrase)).lower()})" for i, w in enumerate(own)]
    base = " UNION ALL ".join(
        f"SELECT a.doc_id, a.p, '{label}' AS label FROM words a " + " ".join(f"JOIN words w{i} ON w{i}.doc_id = a.doc_id AND w{i}.p = a.p + {i} AND w{i}.w = '{w}'" for i, w in enumerate(phrase.split()) if i) + f" WHERE a.w = '{phrase.split()[0]}'"
        for phrase, label in BASE.items()
    )
    return f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs),
templates(t, label, i, w, is_key) AS (VALUES {", ".join(rows)}),
base AS ({base}),
based AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list_distinct(list(label))) AS base_list FROM base GROUP BY doc_id),
stood AS (
  SELECT doc_id, t.t, any_value(label) AS label, p - i AS start, count(*) AS n, count(*) FILTER (is_key) AS n_key
  FROM words JOIN templates t USING (w) GROUP BY doc_id, t.t, p - i),
sizes AS (SELECT t, count(*) AS n, count(*) FILTER (is_key) AS n_key FROM templates GROUP BY t),
found AS (
  SELECT doc_id, label, s.n::DOUBLE / z.n AS share FROM stood s JOIN sizes z USING (t) WHERE s.n_key = z.n_key AND s.n::DOUBLE / z.n >= {least}),
more AS (SELECT doc_id, list(label) AS labels, round(max(share), 6) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_list, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_list, []), coalesce(m.labels, [])))), ','), '') AS labels,
  coalesce(m.score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN based USING (doc_id) LEFT JOIN more m USING (doc_id)"""
