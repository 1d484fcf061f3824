"""Fuzzy line deduplication by MinHash (operator 1).

Lines that are equal after lower-casing and after white space is folded are copies. Every different line
becomes its set of SHINGLE-character shingles; BANDS bands of ROWS MinHash values propose pairs
(a pair of similarity 0.8 is met with a chance of 0.998), the exact Jaccard similarity of the whole sets decides,
and a distributed union-find joins the links. Of each component the first line stays (smallest
document id, then text, then line number); every other occurrence goes.

Defined cases: blank lines always stay and are compared with nothing. A line shorter than a shingle is one
shingle. A null or empty text stays as it is, as do the lines of a row with a null id. Rows with the same id and text
count as one document: each keeps what the first keeps. Rows with the same id and other texts are other documents; of
a line that several of them begin with, one of them keeps it. A document may lose all of its lines; its text is then empty. Line identity is a 64-bit hash of the folded line. Columns besides doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, distinct, fold, minhash_rows, release, salted_join, span_hashes, stage, table, unstage, window_hashes
from ._simjoin import bucket_join, connected_components, jaccard_verify, meeting

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 8, 0.8, 12, 4, 77
#: Line hashes a task remembers.
SEEN = 300_000


def folded(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(line_hash, lines), np.uint64, len(lines)).view(np.int64)


def char_shingles(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, and their number for each line; lines are not empty."""
    units = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.maximum(sizes - n + 1, 1)
    first = np.cumsum(sizes) - sizes
    if len(units) < n or (sizes < n).any():
        at = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(first - at[:-1], counts) + np.arange(at[-1])
        return span_hashes(units, begin, np.minimum(begin + n, np.repeat(first + sizes, counts))), counts
    # All windows, less those that cross into the next line.
    h = window_hashes(units, n)
    inside = np.ones(len(h), bool)
    ends = first[1:]
    for back in range(1, n):
        inside[ends - back] = False
    return h[inside], counts


def _lines(text: str | None) -> list[tuple[int, str]]:
    """Number and folded form of the lines that are not blank."""
    return [(n, f) for n, line in enumerate((text or "").lower().split("\n")) if (f := " ".join(line.split()))]


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            docs, txts, numbers, texts = [], [], [], []
            for doc, txt, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "txt", "text"))):
                for number, line in _lines(text):
                    docs.append(doc)
                    txts.append(txt)
                    numbers.append(number)
                    texts.append(line)
            yield docs, txts, numbers, texts


def _band_keys(lines: list[str], bands: int, rows: int, n: int) -> np.ndarray:
    out = []
    for short in (True, False):  # apart, as only lines of a shingle and more are cut by windows
        own = [t for t in lines if (len(t) < n) == short]
        h, counts = char_shingles(own, n)
        sig = minhash_rows(h, counts, bands * rows, SEED).reshape(-1, bands, rows)
        out.append(np.stack([fold(sig[:, b], b + 1) for b in range(bands)], axis=1))
    is_short = np.fromiter((len(t) < n for t in lines), bool, len(lines))
    keys = np.empty((len(lines), bands), np.int64)
    keys[is_short], keys[~is_short] = out
    return keys


def _scan(bands: int, rows: int, n: int):
    """A row for each line's place (lid, doc_id, txt, line, first in its document); where a task meets a line first, with its band keys."""
    schema = pa.schema([("lid", pa.int64()), ("keys", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("txt", pa.int64()), ("line", pa.int32()), ("first", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a frequent line gives its keys about once a task
        for docs, txts, numbers, texts in _slices(batches):
            lids = line_hashes(texts)
            own: set[tuple[int, int]] = set()
            first, new, at = [], [], []
            for k, key in enumerate(zip(txts, lids.tolist())):
                first.append(key not in own)
                own.add(key)
                if key[1] not in seen:
                    seen.add(key[1])
                    new.append(texts[k])
                    at.append(k)
            if len(seen) > SEEN:
                seen.clear()
            keys = [_band_keys(new[x:y], bands, rows, n).ravel() for x, y in chunks(new)]
            counts = np.zeros(len(texts) + 1, np.int64)
            counts[np.array(at, np.int64) + 1] = bands
            has = counts[1:] > 0
            offsets = pa.array(np.cumsum(counts).astype(np.int32), mask=np.append(~has, False)) if len(texts) else pa.array([0], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(lids), lists, pa.array(docs, pa.int64()), pa.array(txts, pa.int64()), pa.array(numbers, pa.int32()), pa.array(first, pa.bool_())], schema=schema)

    return scan


def _payloads(bands: int, rows: int, n: int):
    schema = pa.schema([("id", pa.int64()), ("weight", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary())])

    def make(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, found = batch.slice(lo, 256), []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    lines = text.split("\n")
                    found += [(w["lid"], folded(lines[w["line"]])) for w in wanted]
                for x, y in chunks([t for _, t in found]):
                    keys = _band_keys([t for _, t in found[x:y]], bands, rows, n)
                    kept = [(i, 1, k.tobytes(), t.encode("utf-8", "surrogatepass")) for (i, t), k in zip(found[x:y], keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)

    return make


def _decoder(n: int):
    def decode(buffers) -> list[np.ndarray]:
        lines = [str(b, "utf-8", "surrogatepass") for b in buffers]
        out = []
        for x, y in chunks(lines):
            h, counts = char_shingles(lines[x:y], n)
            out += [distinct(s) for s in np.split(h, np.cumsum(counts)[:-1])]
        return out

    return decode


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, txt, removed array<int>): line numbers, from 0, that repeat an earlier line of the corpus, of the text with the hash txt."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("txt")).where("doc_id is not null and text is not null")
    scanned = stage(docs.mapInArrow(_scan(bands, rows, shingle), "lid long, keys array<long>, doc_id long, txt long, line int, first boolean"), "op1-lines", "snappy")
    places = scanned.select("lid", "doc_id", "txt", "line", "first")
    # Both minima meet the same rows in the same order, so they are of one row. Primitive values keep this a hash aggregation.
    first_here = F.when(F.col("first"), F.col("doc_id"))
    known = stage(places.groupBy("lid").agg(F.min(first_here).alias("at_doc"), F.min_by("txt", first_here).alias("at_txt"), F.min_by("line", first_here).alias("at_line"), F.count("*").alias("n")), "op1-known")

    def items(ids: DataFrame) -> DataFrame:
        met = known.join(ids.withColumnRenamed("id", "lid"), "lid", "left_semi")
        by_doc = met.groupBy(F.col("at_doc").alias("doc_id"), F.col("at_txt").alias("txt")).agg(F.collect_list(F.struct(F.col("at_line").alias("line"), "lid")).alias("wanted"))  # lines of one document
        return docs.join(by_doc.hint("shuffle_hash"), ["doc_id", "txt"]).select("text", "wanted").mapInArrow(_payloads(bands, rows, shingle), "id long, weight long, keys binary, payload binary").dropDuplicates(["id"])

    keys = scanned.where("keys is not null").select(F.col("lid").alias("id"), F.explode("keys").alias("key"))
    links = bucket_join(items, jaccard_verify(threshold), _decoder(shingle), meeting(keys, "op1"), "op1").where("id is not null")
    release(docs.sparkSession)
    groups = connected_components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "op1").withColumnRenamed("id", "lid")
    repeated = known.join(groups, "lid", "left").where("n > 1 or component is not null")
    repeated = stage(repeated.select("lid", "n", F.coalesce("component", "lid").alias("component"), F.struct(F.col("at_doc").alias("doc_id"), F.col("at_txt").alias("txt"), F.col("at_line").alias("line")).alias("place")), "op1-repeated", compact=True)
    first = repeated.groupBy("component").agg(F.min("place").alias("stays"), F.count("*").alias("lines"))
    gone = stage(salted_join(repeated, first, ["component"], "lid", "lines", total=repeated.count()).select("lid", "n", "stays"), "op1-gone", compact=True)
    # Spread by document: copies of a document have one txt.
    out = salted_join(places, gone, ["lid"], "doc_id", "n").where("struct(doc_id, txt, line) <> stays")
    lost = stage(out.groupBy("doc_id", "txt").agg(F.collect_set("line").alias("removed")), "op1-removed")  # lines of one document
    for t in (scanned, known, links, repeated, gone):
        unstage(t)
    release(docs.sparkSession)
    return lost


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with its columns, less the lines that repeat an earlier one, and the new columns n_lines and n_removed."""
    lost = removed_lines(docs, **options).select(F.col("doc_id").alias("_quillon_of"), F.col("txt").alias("_quillon_txt"), F.col("removed").alias("_quillon_lost"))
    joined = docs.join(lost.hint("shuffle_hash"), (docs["doc_id"].cast("long") == F.col("_quillon_of")) & (F.xxhash64(docs["text"]) == F.col("_quillon_txt")), "left")
    # The lines are a column of their own, or each access below would split the text again.
    split = joined.select("*", F.split(docs["text"], "\n").alias("_quillon_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_quillon_lines") - 1), F.col("_quillon_lost"))
    text = F.when(F.col("_quillon_lost").isNull(), docs["text"]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_quillon_lines", i)), "\n"))
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return split.select(*columns, F.when(docs["text"].isNull(), 0).otherwise(F.size("_quillon_lines")).alias("n_lines"), F.when(F.col("_quillon_lost").isNull(), 0).otherwise(F.size("_quillon_lost")).alias("n_removed"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars, text_sha256): the last two of the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
