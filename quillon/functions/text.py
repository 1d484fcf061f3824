"""String operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_tokens(label: Column) -> Column:
    """Tokens of a label split at + _ | , ; and white space."""
    return F.filter(F.split(label, r"[+_|,;\s]+"), lambda x: x != "")


def canonical_key(targets: Column) -> Column:
    """Distinct sorted targets joined by +."""
    return F.array_join(F.array_sort(F.array_distinct(targets)), "+")


def bag_key(text: Column) -> Column:
    """H_ and ten digits of the hash of the distinct sorted words."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")))
    return F.concat(F.lit("H_"), F.substring(F.sha2(F.array_join(words, " "), 256), 1, 10))


def parse_number(raw: Column) -> Column:
    """NA, empty and NaN are NULL, a per cent value becomes a share rounded to 4 places, others are rounded to 6."""
    return F.when(raw.isin("NA", "", "NaN"), F.lit(None).cast("double")).when(raw.endswith("%"), F.round(F.replace(raw, F.lit("%"), F.lit("")).try_cast("double") / 100, 4)).otherwise(F.round(raw.try_cast("double"), 6))


def json_shape(doc: Column) -> Column:
    """Kind of a JSON document: 'screen' (an object with genes and perts), 'table' (an object of objects), 'sets' (of arrays),
    'network' (an array of arrays), 'list' (an array of texts) or 'other', which is also what is no JSON."""
    variant = F.try_parse_json(doc)
    kind = F.coalesce(F.schema_of_variant(variant), F.lit(""))
    # The types of the first level, without what they hold.
    level = F.regexp_replace(F.regexp_extract(kind, "^OBJECT<(.*)>$", 1), r"<[^<>]*(<[^<>]*(<[^<>]*(<[^<>]*>[^<>]*)*>[^<>]*)*>[^<>]*)*>", "")
    types = F.transform(F.split(level, ", "), lambda x: F.element_at(F.split(x, ": "), -1))
    inside = lambda name: kind.startswith("OBJECT<") & F.forall(types, lambda x: x == name)
    screen = F.try_variant_get(variant, "$.genes", "variant").isNotNull() & F.try_variant_get(variant, "$.perts", "variant").isNotNull()
    return F.when(screen, "screen").when(inside("OBJECT"), "table").when(inside("ARRAY"), "sets").when(kind.startswith("ARRAY<ARRAY"), "network").when(kind == "ARRAY<STRING>", "list").otherwise("other")
