"""Best-fit packing by a configuration linear program (operator 2).

Texts become token ids; those longer than a sequence are cut into full pieces and a rest. The
lengths of all pieces form a histogram of at most CAPACITY values. On it the driver solves the
configuration linear program (fewest sequences that cover every length's count, a variable for
each way to fill a sequence) by multiplicative weights: lengths covered less weigh more, and a
knapsack dynamic program prices the best ways to fill a sequence under these weights. Configurations enter
by whole sequences and hold no more pieces than are left; until at most TOLERANCE of the tokens is left
for best fit, longest first. Best fit alone is taken if it needs fewer sequences. The result is a plan of
rank ranges for each length, whose size depends on CAPACITY and ROUNDS and not on the documents;
every piece finds its place from its rank among the pieces of its length.

Defined cases: a null text is an empty one, which holds the end token alone. Rows with a null id and
repeated rows are packed like any others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage, table

CAPACITY, END_ID, SALTS, PART_ROWS = 4096, 1, 64, 200_000
#: Share of the tokens that may be left to best fit, and rounds after which the search for it ends; how near to the best
#: price a configuration must be at first, and the share of the rest that a round should cover.
TOLERANCE, ROUNDS, NEAR, PROGRESS = 0.01, 400, 0.001, 0.01
#: How fast weights fall, the power of a length in its weight, and the part of what is left that a configuration takes at once.
ETA, LONG, PART = 2.0, 1.05, 16
#: Words kept in a worker's cache.
CACHE_WORDS = 400_000

# Characters whose case, normal form and class do not depend on their neighbours; other texts go to the tokenizer whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ]")
_LETTER = "a-zªµºß-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_PIECE = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Words are encoded once and kept: the tokenizer treats the words of its own splitting rule alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.final[i] = token.endswith("</w>")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        ids = self._ids(" ".join(new))
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) == len(new) and (not len(ids) or ends[-1] == len(ids)):
            data, lo = ids.tobytes(), 0
            for word, hi in zip(new, (ends * 4).tolist()):
                self.words[word] = data[lo:hi]
                lo = hi
        else:
            for word in new:
                self.words[word] = self._ids(word).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = [None if _OTHER.search(t) or "<|" in t else _PIECE.findall(t.lower()) for t in texts]
        known = self.words
        new = set().union(*(f for f in found if f)) - known.keys()
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set().union(*(f for f in found if f))
            new = list(new)
            for lo in range(0, len(new), 20_000):
                self._learn(new[lo : lo + 20_000])
        get = known.__getitem__
        return [self._ids(t).tobytes() if f is None else b"".join(map(get, f)) for t, f in zip(texts, found)]


_tokenizers: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    if path not in _tokenizers:
        _tokenizers[path] = TokenBytes(path)
    return _tokenizers[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cutter(path: str, capacity: int):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc, data in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()])):
                    data += end
                    for k, x in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[x : x + 4 * capacity]
                        rows.append((doc, k, x // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return cut


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each space, and the last length put in (0: none)."""
    value = np.full(capacity + 1, -np.inf)
    value[lengths] = weights
    # Reversed, so that both operands of a space are contiguous: down[capacity - c] is best[c].
    down, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    own = np.empty(capacity + 1)
    for c in range(1, capacity + 1):
        at = capacity - c
        np.add(value[1 : c + 1], down[at + 1 :], out=own[:c])
        k = int(own[:c].argmax())
        if own[k] > down[at + 1]:
            down[at], last[c] = own[k], k + 1
        else:
            down[at] = down[at + 1]
    best = down[::-1]
    return best, last


def _fill(first: int, values: np.ndarray, best: np.ndarray, rest: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The filling that the prices lead to, from `first` on, of no more pieces of a length than are left; and its worth."""
    config: dict[int, int] = defaultdict(int)
    left, space, worth, k = values.copy(), capacity, 0.0, first
    while True:
        config[k] += 1
        space -= k
        worth += values[k]
        if config[k] >= rest[k]:
            left[k] = -np.inf
        if not space:
            break
        own = left[1 : space + 1] + best[space - 1 :: -1]
        k = int(own.argmax()) + 1
        if own[k - 1] == -np.inf:
            break
    return config, worth


def configure(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[tuple[tuple[int, int], ...], int]:
    """The linear program's configurations, each with how often to use it; what they leave is packed best fit."""
    total = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        total[length] = n if length < capacity else 0
    rest, near = total.copy(), NEAR
    enough = max(capacity, TOLERANCE * int((np.arange(capacity + 1) * total).sum()))
    used: dict[tuple, int] = defaultdict(int)
    for _ in range(ROUNDS):
        lengths = np.flatnonzero(rest)
        before = int((lengths * rest[lengths]).sum())
        if before < enough:
            break
        # Weights fall with the share of a length that is covered already; of exact fillings that of long pieces is worth most.
        values = np.full(capacity + 1, -np.inf)
        values[lengths] = (lengths / capacity) ** LONG * np.exp(-ETA * (1 - rest[lengths] / total[lengths]))
        best, _ = price(values[lengths], lengths, capacity)
        least = (1 - near) * best[capacity]
        for first in lengths[::-1].tolist():
            if not rest[first] or values[first] + best[capacity - first] < least:
                continue
            config, worth = _fill(first, values, best, rest, capacity)
            if worth < least:
                continue
            # A part of what is left, so that other configurations of a length get theirs; whole sequences, so that rounding loses none.
            step = max(1, min(int(rest[k]) // a for k, a in config.items()) // PART)
            used[tuple(sorted(config.items(), reverse=True))] += step
            for k, a in config.items():
                rest[k] -= a * step
                if not rest[k]:
                    values[k] = -np.inf
        # Prices move on with what is covered; where a round covers little, worse configurations are let in.
        if before - int((np.arange(capacity + 1) * rest).sum()) < PROGRESS * before:
            near = min(1.0, near * 1.5)
    return dict(used)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, copies), ...) with how often to use each; together they hold every piece once."""
    full: list[tuple[tuple[tuple[int, int], ...], int]] = [(((capacity, 1),), n) for length, n in histogram.items() if length == capacity]
    left = {k: n for k, n in histogram.items() if k != capacity}
    alone = _best_fit(dict(left), capacity)
    out = list(configure(histogram, capacity).items())
    for config, n in out:
        for k, a in config:
            left[k] -= n * a
    out += _best_fit({k: n for k, n in left.items() if n}, capacity)
    # Where best fit reaches the bound, rounding may cost a sequence more.
    return full + min(out, alone, key=lambda x: sum(n for _, n in x))


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, over counts: one filling is repeated as often as the counts allow."""
    import bisect

    out = []
    lengths = sorted(left)
    while lengths:
        config: dict[int, int] = {}
        space = capacity
        at = len(lengths)
        while at and space:
            at = bisect.bisect_right(lengths, space, 0, at)
            if not at:
                break
            k = lengths[at - 1]
            a = min(left[k], space // k)
            config[k] = a
            space -= a * k
            at -= 1
        n = min(left[k] // a for k, a in config.items())
        out.append((tuple(config.items()), n))
        for k, a in config.items():
            left[k] -= n * a
            if not left[k]:
                lengths.pop(bisect.bisect_left(lengths, k))
    return out


def plan(configurations) -> dict[str, np.ndarray]:
    """Rank ranges: pieces of a length from rank `first` on go to sequences from `base` on, `copies` to each."""
    rows, used, base = [], defaultdict(int), 0
    for config, n in configurations:
        offset = 0
        for length, copies in config:
            rows.append((length, used[length], base, offset, copies))
            used[length] += n * copies
            offset += length * copies
        base += n
    rows.sort()
    return {c: np.array([r[k] for r in rows], np.int64) for k, c in enumerate(("length", "first", "base", "offset", "copies"))}


_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _placer(p: dict[str, np.ndarray]):
    shift = np.int64(1 << 44)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = p["length"] * shift + p["first"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * shift + rank, side="right") - 1
            own, copies = rank - p["first"][at], p["copies"][at]
            places = [pa.array(p["base"][at] + own // copies), pa.array(p["offset"][at] + own % copies * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PIECES.names), *places], schema=_PLACED)

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece."""
    path = tokenizer_path or default_tokenizer()
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(path, capacity), fields), "op2-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    # A length may hold a large part of all pieces: ranks are counted in parts of each length, of PART_ROWS pieces or so.
    salts = max(SALTS, max(histogram.values(), default=0) // PART_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "op2-counts")
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order) - 1).join(before.hint("shuffle_hash"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return ranked.mapInArrow(_placer(plan(solve(histogram, capacity))), fields + ", sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
