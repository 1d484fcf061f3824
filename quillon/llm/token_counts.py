"""Token counts with overlap resynchronisation (operator 13).

Texts up to a chunk's size are counted whole, where they are read. Longer ones are cut into chunks that reach past their
end into the next chunk, and the chunks of all distinct texts are dealt to all tasks. Each is encoded with the places where its
words begin (a token that ends a word closes it). Two neighbours are spliced at a place where a word begins in both, which proves that the
tokens of the whole text change hands there:

* the tokenizer splits words from left to right by a pattern without look-behind, so what follows a word's beginning does not depend
  on what precedes it, and merges stay within words;
* the place is at least GUARD characters before the end of the left chunk: no special token and no look-ahead of a word before
  it reaches beyond that end;
* the character there is no mark and no conjoining letter: normal forms do not reach over it.

The left chunk's tokens are those of the text up to its last splice, so by induction all are. Where two neighbours have no such place in common,
their overlap is made WIDEN times as wide and the text is encoded again; an overlap that would pass half of the next chunk swallows
that chunk. One chunk is left at worst, which is the whole text.

Defined cases: a null text counts as an empty one, with 0 bytes and tokens. Rows with a null id, repeated rows and rows
of one id with other texts are counted each by its own text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, salted_join, stage, table, unstage
from .packing import _OTHER, _PIECE, CACHE_WORDS, TokenBytes, default_tokenizer

#: Characters of a chunk, of the first overlap, of the distance from a chunk's end that no special token and no look-ahead spans, and the step of widening.
CHUNK, OVERLAP, GUARD, WIDEN = 16_384, 512, 64, 4
LIMIT = 2048


class TokenCounter(TokenBytes):
    """Numbers of tokens of texts, and of their words by place."""

    def count(self, texts: list[str]) -> list[int]:
        return [len(b) // 4 for b in self(texts)]

    def places(self, text: str) -> tuple[list[int], list[int], int]:
        """Where each word begins, in characters, how many tokens precede it, and the number of all."""
        if _OTHER.search(text) or "<|" in text:
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(encoded.ids, np.int64)
            begin, end = np.array(encoded.offsets, np.int64).reshape(-1, 2).T
            # A character that becomes two may end a word and begin the next: that is no place between characters.
            first = np.flatnonzero(np.concatenate([[True], self.final[ids[:-1]] & (end[:-1] <= begin[1:])])) if len(ids) else np.zeros(0, np.int64)
            return begin[first].tolist(), first.tolist(), len(ids)
        found = list(_PIECE.finditer(text.lower()))  # of these characters, each has one small letter
        words = [m.group() for m in found]
        new = list(set(words) - self.words.keys())
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(set(words))
        for lo in range(0, len(new), 20_000):
            self._learn(new[lo : lo + 20_000])
        before = [0, *accumulate(len(self.words[w]) // 4 for w in words)]
        return [m.start() for m in found], before[:-1], before[-1]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def stable(c: str) -> bool:
    """No normal form joins this character to what precedes it."""
    return not unicodedata.category(c).startswith("M") and not 0x1160 <= ord(c) <= 0x11FF and not 0xD7B0 <= ord(c) <= 0xD7FF


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [n for lo, hi in chunks(texts) for n in count(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


_CUT = "digest string, k int, start int, before int, after int, next int, text string"


def _cutter(chunk: int, overlap: int):
    """Chunks of texts (digest, text, starts, overlaps); before and after: overlaps with the neighbours; next: start of the next chunk, -1 if none."""
    fields = pa.schema([("digest", pa.string()), *((c, pa.int32()) for c in ("k", "start", "before", "after", "next")), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                digest, text, starts, overlaps = (b.column(c)[row].as_py() for c in ("digest", "text", "starts", "overlaps"))
                if starts is None:
                    # The last chunk is no shorter than half of one, or its overlap would pass it.
                    starts = list(range(0, max(1, len(text) - chunk // 2), chunk))
                    overlaps = [0, *[overlap] * (len(starts) - 1)]
                ends, after = [*starts[1:], -1], [*overlaps[1:], 0]
                for lo in range(0, len(starts), 64):
                    part = [(digest, k, starts[k], overlaps[k], after[k], ends[k], text[starts[k] : ends[k] + after[k] if ends[k] >= 0 else len(text)]) for k in range(lo, min(lo + 64, len(starts)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), fields)], schema=fields)

    return run


_ENCODED = "digest string, k int, start int, before int, size int, total long, head array<int>, head_tokens array<long>, tail array<int>, tail_tokens array<long>"


def _encoder(path: str):
    """Tokens of each chunk; head and tail: the places in both overlaps where a splice may be, and the tokens before them."""
    fields = pa.schema([("digest", pa.string()), ("k", pa.int32()), ("start", pa.int32()), ("before", pa.int32()), ("size", pa.int32()), ("total", pa.int64()), ("head", pa.list_(pa.int32())), ("head_tokens", pa.list_(pa.int64())), ("tail", pa.list_(pa.int32())), ("tail_tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            rows = []
            for digest, k, start, before, after, following, text in zip(*(b.column(c).to_pylist() for c in ("digest", "k", "start", "before", "after", "next", "text"))):
                at, tokens, total = own.places(text)
                edges = []
                for lo, hi in ((start, start + before), (following, following + after - GUARD)):
                    near = [(start + p, n) for p, n in zip(at, tokens) if lo <= start + p < hi and stable(text[p])]
                    edges += [[p for p, _ in near], [n for _, n in near]]
                rows.append((digest, k, start, before, len(text), total, *edges))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields], schema=fields)

    return run


def _spliced(encoded: DataFrame) -> DataFrame:
    """(digest, n_tokens, starts, overlaps): of texts whose chunks all join, n_tokens; of others the next cut."""
    sides = F.array(
        F.struct(F.col("k"), F.lit(True).alias("right"), F.col("head").alias("at"), F.col("head_tokens").alias("tokens")),
        F.struct((F.col("k") + 1).alias("k"), F.lit(False).alias("right"), F.col("tail").alias("at"), F.col("tail_tokens").alias("tokens")),
    )
    sided = encoded.select("digest", "start", "before", "size", "total", F.explode(sides).alias("s")).select("digest", "start", "before", "size", "total", "s.*")
    of = lambda c, right: F.max(F.when(F.col("right") == F.lit(right), F.col(c)))  # noqa: E731  one row a side
    seams = sided.groupBy("digest", "k").agg(*(of(c, r).alias(f"{c}_{'right' if r else 'left'}") for c in ("at", "tokens", "total") for r in (True, False)), *(of(c, True).alias(c) for c in ("start", "before", "size")))
    seams = seams.where("start is not null")  # after the last chunk there is no seam
    place = F.array_min(F.array_intersect("at_left", "at_right"))
    tokens = lambda side: F.element_at(f"tokens_{side}", F.array_position(f"at_{side}", F.col("place")).cast("int"))
    seams = seams.withColumn("place", place)
    # Tokens that the seam adds to the count: the right chunk's, less those that the left one has beyond the place and the right one before it.
    joined = F.when(F.col("k") == 0, F.col("total_right")).otherwise(F.col("total_right") - (F.col("total_left") - tokens("left")) - tokens("right"))
    seams = seams.select("digest", "k", "start", "before", "size", joined.alias("own"), ((F.col("k") > 0) & F.col("place").isNull()).alias("open"))
    all_of = F.array_sort(F.collect_list(F.struct("start", "before", "size", "open")))  # chunks of one text
    texts = seams.groupBy("digest").agg(F.sum("own").alias("sum"), F.max("open").alias("open"), all_of.alias("chunks"))
    return texts.select("digest", F.when(~F.col("open"), F.col("sum")).alias("n_tokens"), F.when(F.col("open"), F.col("chunks")).alias("chunks"))


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open seams get wider overlaps, or go with what would be passed by half."""
    for b in batches:
        rows = []
        for digest, found in zip(b.column("digest").to_pylist(), b.column("chunks").to_pylist()):
            starts, overlaps = [], []
            for k, c in enumerate(found):
                overlap = c["before"] * WIDEN if c["open"] else c["before"]
                room = found[k + 1]["start"] - c["start"] if k + 1 < len(found) else c["size"]
                if c["open"] and overlap * 2 > room:
                    continue
                starts.append(c["start"])
                overlaps.append(overlap)
            rows.append((digest, starts, overlaps))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in (1, 2))], ["digest", "starts", "overlaps"])


def long_texts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(digest, n_tokens) of the distinct texts of (digest, text), by spliced chunks."""
    if not GUARD < overlap <= chunk // 2:
        raise ValueError(f"an overlap has more than {GUARD} characters and at most half of a chunk")
    todo = texts.select("*", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("overlaps"))
    done, cuts = [], None
    while True:
        cut = todo.mapInArrow(_cutter(chunk, overlap), _CUT).dropDuplicates(["digest", "k"])  # copies are encoded once
        spliced = stage(_spliced(cut.mapInArrow(_encoder(path), _ENCODED)), "op13-spliced")
        done.append(spliced.where("n_tokens is not null").select("digest", "n_tokens"))
        open_texts = spliced.where("n_tokens is null")
        if cuts is not None:
            unstage(cuts)
        if open_texts.isEmpty():
            return reduce(DataFrame.unionAll, done)
        cuts = stage(open_texts.select("digest", "chunks").mapInArrow(_widen, "digest string, starts array<int>, overlaps array<int>"), "op13-cuts")
        todo = texts.join(cuts, "digest")


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs (doc_id, text)."""
    path = tokenizer_path or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    fits = F.length("text") <= chunk + overlap
    short = docs.where(fits).mapInArrow(_whole(path), "doc_id long, n_bytes long, n_tokens long")
    large = docs.where(~fits).withColumn("digest", F.sha2("text", 256))
    counts = long_texts(large.select("digest", "text"), path, chunk, overlap)
    rows = large.select("doc_id", "n_bytes", "digest")
    counts = counts.join(rows.groupBy("digest").agg(F.count("*").alias("rows")), "digest")
    spliced = salted_join(rows, counts, ["digest"], "doc_id", "rows").select("doc_id", "n_bytes", "n_tokens")
    return short.unionAll(spliced).withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
