"""Cross-tokenizer alignment (operator 12).

Both tokenizers begin a token before a space or line feed that follows other text: the first splits there before it merges,
and no piece of the second holds a space or line feed after another character (this is checked when it is loaded). So a text falls into units, runs of such
white space with what follows, and its tokens, groups and links are those of its units in order. A task gathers the units of its Arrow batches, and an
in-process DuckDB aligns those that are new to it: interval tables of both tokenizers' tokens in bytes, an ASOF join for the token over
each token's first byte, a range join for those that begin inside it, and window sums of the common ends that number the groups. From these
and the units of each document it sums up every document's linked id pairs.

Documents are handed on in chunks of CHUNK characters or so: a row has its distinct pairs with the documents that hold them, and every
document's pairs as positions in that list. Spark adds up the partial counts of all chunks, finds each A id's highest, and brings the
counts back to the chunks by the pair, of which a chunk has each once, however many documents hold it. Nothing of the corpus is broadcast.

Defined cases: texts that are null, empty or that a tokenizer doesn't give back byte by byte have no tokens: zeros and an empty digest.
Repeated rows count as documents each; rows with a null id are rows like others. An empty table gives no rows. Texts of any
length are aligned in steps of STEP characters, whose memory is bounded but for a single unit; a unit without white space is tokenized whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage, table

#: Characters of a chunk of documents and of a step within one; units that a task remembers.
CHUNK, STEP, UNITS = 1 << 22, 1 << 20, 300_000
#: Units that the second tokenizer gets at once.
PART = 500

#: A unit begins at a space or line feed that follows neither white space nor the second tokenizer's own sign for it.
_BEGIN = re.compile("(?<![\\s▁᠎])(?=[ \n])")
#: White space and its sign, beside space and line feed; without these, units are simply found. A unit that ends in any may join with what follows.
_ODD_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "▁᠎"
_OPEN_ENDS = _ODD_SPACES + " \n"
_PLAIN_UNIT = re.compile("[ \n]+[^ \n]*")
#: Characters whose classes all libraries agree on, and the first tokenizer's splitting rule.
_SETTLED = re.compile("[\n -~\xa1-\xac\xae-ɏЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥]*")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level tokens write printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=second)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.fast = self._ranked(vocabulary)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁|\n", piece) and not self.b.is_control(i):
                raise ValueError(f"piece {piece!r} goes over the beginning of a unit")
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.space = self.b.piece_to_id("▁")
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        #: Ids as text, followed by each separator.
        self.names = [f"{i}{end}" for x in (self.a_bytes, self.b_bytes) for end in ENDINGS for i in range(len(x))]

    def _ranked(self, vocabulary: dict[str, int]):
        """The first tokenizer's vocabulary as ranks, for a faster library; None if its ids don't follow its merges."""
        import tiktoken

        model = json.loads(self.a.to_str())["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if any(vocabulary.get(m) != 256 + k for k, m in enumerate(merges)) or sorted(map(len, self.a_bytes[:256])) != [1] * 256:
            return None
        return tiktoken.Encoding("first", pat_str=_WORDS, mergeable_ranks={x: i for i, x in enumerate(self.a_bytes[: 256 + len(merges)])}, special_tokens={})

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for units, one after the other, none but the last with an open end; None if either doesn't give back their bytes."""
        text = "".join(units)
        a = self.fast.encode_ordinary(text) if self.fast and _SETTLED.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids
        b = []
        for lo in range(0, len(units), PART):
            part = "".join(units[lo : lo + PART])
            if part == " ":
                b.append(self.space)
            elif part.startswith(" "):
                b += self.b.encode(part[1:])
            else:  # the space that is added before a line feed stays alone
                b += self.b.encode(part)[1:]
        data = text.encode()
        a = np.array(a, np.int64)
        # Byte tokens are all there, so the first gives back its input if the lengths agree.
        if self.sizes[0][a].sum() != len(data) or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return a, np.array(b, np.int64)


_pairs: dict[tuple[str, str], Pair] = {}

#: Between tokens of a side, between the sides of a group, between groups, and at the end.
ENDINGS = (",", "|", ";", "")

_GROUPS = """CREATE OR REPLACE TEMP TABLE {t}_groups AS
SELECT unit, s, e, id, coalesce(sum(common::INT) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM (SELECT *, e IN (SELECT e FROM {other}) AS common FROM {t})"""
_LINKS = """INSERT INTO links
SELECT a.number, (a.id << 32) | b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL
SELECT a.number, (a.id << 32) | b.id FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e"""


class Aligner:
    """Units of a task, aligned when first met, in a DuckDB of its own."""

    def __init__(self, pair: Pair):
        import duckdb

        self.pair = pair
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET temp_directory = ''")
        self.db.execute("CREATE TABLE doc_pairs (doc BIGINT, pair BIGINT, m BIGINT)")
        self._forget_all()

    def _forget_all(self) -> None:
        self.known: dict[str, int] = {}
        #: n_a, n_b, n_groups and n_links of each unit (-1: it has no tokens that give back its bytes), its groups as text, and how often it was met.
        self.numbers, self.met = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        self.texts: list[str] = []
        self.db.execute("CREATE OR REPLACE TABLE links (number BIGINT, pair BIGINT)")

    def forget(self, most: int) -> None:
        """Of more than `most` units, those go that were met once; all, where half would not."""
        if len(self.texts) <= most:
            return
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > most // 2:
            return self._forget_all()
        names = list(self.known)
        self.known = {names[k]: at for at, k in enumerate(keep.tolist())}
        self.numbers, self.met, self.texts = self.numbers[keep], np.ones(len(keep), np.int64), [self.texts[k] for k in keep.tolist()]
        self.db.register("kept", pa.table({"old": keep, "number": np.arange(len(keep))}))
        self.db.execute("CREATE OR REPLACE TABLE links AS SELECT kept.number, pair FROM links JOIN kept ON links.number = kept.old")
        self.db.unregister("kept")

    def learn(self, units: list[str]) -> None:
        new = list(dict.fromkeys(u for u in units if u not in self.known))
        if not new:
            return
        # Units that end a text may end in white space, which would join with the next unit's: they are encoded alone.
        closed = [k for k, u in enumerate(new) if u[-1] not in _OPEN_ENDS]
        alone = sorted(set(range(len(new))).difference(closed)) if len(closed) < len(new) else []
        plain = _SETTLED.fullmatch("".join(new[k] for k in closed)) is not None
        settled = [plain or _SETTLED.fullmatch(new[k]) is not None for k in closed]
        at, parts = [], []
        for kind in (True, False):
            own = [k for k, x in zip(closed, settled) if x == kind]
            together = self.pair.encode([new[k] for k in own]) if own else None
            if together:
                at += own
                parts.append(together)
            else:  # those that are not given back are found one by one
                alone += own
        for k in alone:
            if single := self.pair.encode([new[k]]):
                at.append(k)
                parts.append(single)
        numbers = np.full((len(new), 4), -1, np.int64)
        texts = [""] * len(new)
        if at:
            self._align(new, at, [np.concatenate([p[side] for p in parts]) for side in (0, 1)], numbers, texts)
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.numbers, self.met = np.concatenate([self.numbers, numbers]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.texts += texts

    def _align(self, new: list[str], at: list[int], ids: list[np.ndarray], numbers: np.ndarray, texts: list[str]) -> None:
        """The units at these places of new, whose bytes lie one after the other, with both sides' tokens."""
        first = len(self.texts)
        ends = np.cumsum([len(new[k].encode()) for k in at])
        places = np.array(at, np.int64)
        for name, own, sizes, side in zip("ab", ids, self.pair.sizes, (0, 1)):
            stop = np.cumsum(sizes[own])
            unit = np.searchsorted(ends, stop)
            self.db.register("frame", pa.table({"unit": unit, "number": places[unit] + first, "s": stop - sizes[own], "e": stop, "id": own}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM frame")
            self.db.unregister("frame")
            numbers[places, side] = np.bincount(unit, minlength=len(at))
        self.db.execute(_LINKS)
        linked = self.db.execute("SELECT number, count(*) AS n FROM links WHERE number >= ? GROUP BY number", [first]).fetchnumpy()
        numbers[linked["number"] - first, 3] = linked["n"]
        sides = []
        for name, other in ("ab", "ba"):
            self.db.execute(_GROUPS.format(t=name, other=other))
            sides.append(self.db.execute(f"SELECT unit, g, id FROM {name}_groups ORDER BY s").fetchnumpy())
        # Both sides' tokens in the order of the text that states the groups, each with what follows it.
        g, unit = (np.concatenate([x[c] for x in sides]) for c in ("g", "unit"))
        side = np.repeat([0, 1], [len(x["g"]) for x in sides])
        order = np.argsort(g * 2 + side, kind="stable")
        g, unit, side, token = g[order], unit[order], side[order], np.concatenate([x["id"] for x in sides])[order]
        ending = np.full(len(g), 3)
        ending[:-1] = np.where(unit[1:] != unit[:-1], 3, np.where(g[1:] != g[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        n_a, n_b = map(len, self.pair.sizes)
        words = list(map(self.pair.names.__getitem__, np.where(side == 0, token + ending * n_a, 4 * n_a + token + ending * n_b).tolist()))
        cuts = np.searchsorted(unit, np.arange(len(at) + 1)).tolist()
        for k, lo, hi in zip(at, cuts, cuts[1:]):
            texts[k] = "".join(words[lo:hi])
        numbers[places, 2] = np.bincount(unit[ending >= 2], minlength=len(at))

    def add_pairs(self, docs: np.ndarray, units: np.ndarray) -> None:
        """Adds the pairs that documents have by these occurrences of units."""
        self.met += np.bincount(units, minlength=len(self.met))
        self.db.register("met", pa.table({"doc": docs, "number": units}))
        self.db.execute("INSERT INTO doc_pairs SELECT doc, pair, sum(n)::BIGINT FROM (SELECT doc, number, count(*) AS n FROM met GROUP BY doc, number) JOIN links USING (number) GROUP BY doc, pair")
        self.db.unregister("met")

    def drop_pairs(self, doc: int) -> None:
        self.db.execute("DELETE FROM doc_pairs WHERE doc = ?", [doc])

    def take_pairs(self, steps: bool) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """The distinct pairs with the number of documents that hold them, and every document's pairs by place in their list. steps: a document may have a pair in several rows."""
        per = self.db.execute("SELECT doc, pair, sum(m)::BIGINT AS m FROM doc_pairs GROUP BY doc, pair" if steps else "SELECT * FROM doc_pairs").fetchnumpy()
        self.db.execute("CREATE OR REPLACE TABLE doc_pairs (doc BIGINT, pair BIGINT, m BIGINT)")
        order = np.argsort(per["doc"], kind="stable")
        pairs, place, held = np.unique(per["pair"][order], return_inverse=True, return_counts=True)
        return pairs, held, {"doc": per["doc"][order], "place": place, "m": per["m"][order]}


_CHUNKS = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]))), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())), ("cuts", pa.binary()), ("at", pa.binary()), ("m", pa.binary())])
_CHUNKS_SQL = "chunk long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, pairs array<long>, held array<long>, cuts binary, at binary, m binary"


def _units(text: str) -> list[str]:
    """Units of a part of a text that begins where one does."""
    return [u for u in _BEGIN.split(text) if u] if any(c in text for c in _ODD_SPACES) else _PLAIN_UNIT.findall(text)


def _steps(text: str, step: int) -> Iterator[list[str]]:
    """The units of a space and text, some `step` characters at a time."""
    text = " " + text
    lo = 0
    while lo < len(text):
        found = _BEGIN.search(text, lo + step)
        hi = found.start() if found else len(text)
        yield _units(text[lo:hi])
        lo = hi


class _Doc:
    """A document of a chunk: its sums so far, and its text until its steps are aligned."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text, self.sound, self.whole = doc_id, text, bool(text), False
        self.total, self.sha = np.zeros(4, np.int64), hashlib.sha256()

    def record(self) -> dict:
        total = self.total.tolist() if self.sound else [0] * 4
        return {"doc_id": self.doc_id, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), total)), "groups_sha256": self.sha.hexdigest() if self.sound else ""}


class _Chunk:
    """Documents of a chunk so far. Steps wait until they have `step` characters together, and are aligned at once."""

    def __init__(self, aligner: Aligner, step: int, most_units: int):
        self.aligner, self.step, self.most_units = aligner, step, most_units
        self.clear()

    def clear(self) -> None:
        self.docs: list[_Doc] = []
        self.size = self.waiting = 0
        self.split = False  # a document's pairs lie in several rows
        self.steps: list[tuple[int, bool, list[str]]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        doc = _Doc(doc_id, text)
        self.docs.append(doc)
        for k, units in enumerate(_steps(text, self.step) if text else ()):
            if not doc.sound or doc.whole:
                break
            self.split |= k > 0
            self.steps.append((len(self.docs) - 1, k > 0, units))
            self.waiting += min(self.step, len(doc.text))
            if self.waiting >= self.step:
                self.flush()
        self.size += len(text or "") + 1

    def flush(self) -> None:
        aligner = self.aligner
        aligner.learn([u for _, _, units in self.steps for u in units])
        met, whole = [], []
        for k, more, units in self.steps:
            doc = self.docs[k]
            if not doc.sound or doc.whole:
                continue
            ids = np.array(list(map(aligner.known.__getitem__, units)), np.int64)
            own = aligner.numbers[ids]
            if (own[:, 0] < 0).any():
                doc.sound = False
                whole.append(k)
                continue
            self._sum(doc, own.sum(0), ids, more)
            met.append((k, ids))
        self._meet([(k, ids) for k, ids in met if self.docs[k].sound])
        for k in whole:  # a unit that is not given back: the text as one unit decides
            doc = self.docs[k]
            aligner.drop_pairs(k)
            aligner.learn([" " + doc.text])
            ids = np.array([aligner.known[" " + doc.text]], np.int64)
            if aligner.numbers[ids[0], 0] >= 0:
                doc.total, doc.sha, doc.sound, doc.whole = np.zeros(4, np.int64), hashlib.sha256(), True, True
                self._sum(doc, aligner.numbers[ids[0]], ids, False)
                self._meet([(k, ids)])
        for doc in self.docs[: len(self.docs) - 1]:
            doc.text = None
        self.steps, self.waiting = [], 0
        aligner.forget(self.most_units)

    def _sum(self, doc: _Doc, numbers: np.ndarray, ids: np.ndarray, more: bool) -> None:
        doc.total = doc.total + numbers
        texts = self.aligner.texts
        doc.sha.update(((";" if more else "") + ";".join([texts[i] for i in ids.tolist()])).encode())

    def _meet(self, met: list[tuple[int, np.ndarray]]) -> None:
        if met:
            self.aligner.add_pairs(np.repeat([k for k, _ in met], [len(ids) for _, ids in met]), np.concatenate([ids for _, ids in met]))

    def row(self, number: int) -> pa.RecordBatch:
        self.flush()
        pairs, held, per = self.aligner.take_pairs(self.split)
        cuts = np.searchsorted(per["doc"], np.arange(len(self.docs) + 1)).astype(np.int64)
        row = [number, [d.record() for d in self.docs], pairs.tolist(), held.tolist(), cuts.tobytes(), per["place"].astype(np.int32).tobytes(), per["m"].astype(np.int64).tobytes()]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNKS)], schema=_CHUNKS)


def _aligned(tokenizers: tuple[str, str], size: int, step: int, most_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizers not in _pairs:
            _pairs[tokenizers] = Pair(*tokenizers)
        chunk, number = _Chunk(Aligner(_pairs[tokenizers]), step, most_units), TaskContext.get().partitionId() << 32
        for b in batches:
            for k in range(b.num_rows):
                chunk.add(b.column("doc_id")[k].as_py(), b.column("text")[k].as_py())
                if chunk.size >= size:
                    yield chunk.row(number)
                    number += 1
        if chunk.docs:
            yield chunk.row(number)
        chunk.aligner.db.close()

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sums over its links, from the counts of its chunk's pairs."""
    for b in batches:
        for k in range(b.num_rows):
            docs = b.column("docs").slice(k, 1).flatten()
            cuts, at, m = (np.frombuffer(b.column(c)[k].as_py(), kind) for c, kind in (("cuts", np.int64), ("at", np.int32), ("m", np.int64)))
            counted = b.column("counted").slice(k, 1).flatten()
            n, best = np.zeros(len(counted), np.int64), np.zeros(len(counted), bool)
            places = counted.field("pos").to_numpy()
            n[places] = counted.field("n").to_numpy()
            best[places] = counted.field("best").to_numpy(zero_copy_only=False)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (m * best[at], m * n[at])]
            n_best, count_sum = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
            columns = [docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(count_sum), docs.field("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold an id pair linked, A's id in the upper half; best: n is the highest of A's id."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, chunk: int = CHUNK, step: int = STEP, units: int = UNITS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stage(rows.mapInArrow(_aligned(tokenizers or default_tokenizers(), chunk, step, units), _CHUNKS_SQL), "op12-chunks")
    own = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair")).join(pair_counts(chunks), "pair")
    counted = own.groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "best")).alias("counted"))  # pairs of one chunk
    return chunks.drop("pairs", "held").join(counted, "chunk", "left").mapInArrow(_finish, _RESULT)


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
