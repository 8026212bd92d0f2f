"""Best-fit packing by sums of squares: documents into as few token sequences as possible.

``tokenized`` turns every whole text into pieces of at most ``capacity`` tokens, each document ended by the token 0;
only a longer document is cut.  ``pack`` deals the pieces' lengths (never their tokens) to blocks of a fixed expected
size by a hash of the document, so no task grows with the input, and packs each block: pieces by falling length, each into
the open bin, or a new one, for which the sum over all gaps of the squared number of open bins with that gap becomes
smallest.  A bin of each gap that occurs is enough to choose from, so a step costs the capacity, not the bins.

Defined cases: a null or empty text is the one token 0; a very long text is tokenized whole and cut into pieces that
blocks share; repeated rows are packed as documents of their own and spread over the blocks; a null doc_id is a key like
any other, and ids keep all their digits; ties in length are broken by the order of the ids, pieces and checksums; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Documents that a block gets on average.
BLOCK = 16_384
#: Words whose ids a worker keeps; beyond it starts afresh.
KEPT = 1_000_000


@cache
def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What each special token begins with.
_SPECIAL = b"<|"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _Numbered(dict):
    """Numbers words in the order in which they are first looked up, and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.fresh.append(word)
        return k


class Words:
    """Token ids of texts through a cache of their words.

    The tokenizer's pre-tokens never span white space, so a text's ids are its words' ids in order.  Between a letter
    and the ASCII symbols that end a word is a border of pre-tokens, so the two parts are looked up.  Special tokens are
    the exception: they are matched as they are spelt and may hold anything, so texts in which one could begin go to the
    tokenizer whole.
    """

    def __init__(self, path: str, keep: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; waiting threads would only spin
        from tokenizers import Tokenizer

        self.of, self.keep = Tokenizer.from_file(path), keep
        self.clear()

    def clear(self) -> None:
        self.number = _Numbered()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _keep(self, words: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[words] = self.used + np.cumsum(count) - count
        self.count[words] = count
        self.used += len(ids)

    def _gather(self, words: np.ndarray) -> np.ndarray:
        n = self.count[words]
        ends = np.cumsum(n)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[words] - ends + n, n)]

    def _learn(self) -> None:
        """Give ids to the words that were looked up for the first time."""
        number, whole, split, parts = self.number, [], [], []
        for w in number.fresh:  # grows by the parts, which come after
            stem = w.rstrip(_SYMBOLS)
            if len(stem) < len(w) and stem and 97 <= stem[-1] <= 122:
                split.append(number[w])
                parts += (number[stem], number[w[len(stem) :]])
            else:
                whole.append(w)
        number.fresh = []
        while len(number) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        for at in range(0, len(whole), 10_000):
            some = whole[at : at + 10_000]
            ids = [e.ids for e in self.of.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(np.fromiter(map(number.__getitem__, some), np.int64, len(some)), np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum())), count)
        if split:
            k = np.array(parts)
            self._keep(np.array(split), self._gather(k), self.count[k].reshape(-1, 2).sum(1))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > self.keep or self.used > 8 * self.keep:
            self.clear()
        look = self.number.__getitem__
        whole = {i: np.array(self.of.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if _SPECIAL in t}
        split = [[] if i in whole else t.lower().replace(b"\n", b" ").split(b" ") for i, t in enumerate(texts)]
        numbers = [np.fromiter(map(look, ws), np.int64, len(ws)) for ws in split]
        self._learn()
        return [whole[i] if i in whole else self._gather(k) for i, k in enumerate(numbers)]


@cache
def words(path: str) -> Words:
    return Words(path)


def tokenized(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, tokens: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and ids if ``tokens``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(path or tokenizer_path())
        for batch in batches:
            for group in _bounded(batch, 1 << 20):
                ids = [np.append(x, np.uint32(0)) for x in coder.encode([t.as_py() or b"" for t in group.column(1).cast(pa.binary())])]
                cut = [(i, p, s) for i, x in enumerate(ids) for p, s in enumerate(range(0, len(x), capacity))]
                part = [ids[i][s : s + capacity].astype("<u4") for i, _, s in cut]
                cols = [
                    group.column(0).take(pa.array([i for i, _, _ in cut], pa.int64())),
                    pa.array([p for _, p, _ in cut], pa.int32()),
                    pa.array([s for _, _, s in cut], pa.int64()),
                    pa.array([len(x) for x in part], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in part], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if tokens:
                    cols.append(pa.array([x.astype(np.int32) for x in part], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens)


def _bounded(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, a longer text alone."""
    size, at = 0, 0
    for i, t in enumerate(batch.column(1)):
        n = t.as_buffer().size if t.is_valid else 0
        if size + n > most and i > at:
            yield batch.slice(at, i - at)
            size, at = 0, i
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each length, taken in the order given.  A bin whose gap is below all lengths is open no more."""
    least = int(lengths.min(initial=capacity))
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = itertools.count()
    far = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            where[i] = next(made)
            continue
        # by how much the sum of squares changes: a bin of gap g becomes one of gap g - s, or is closed
        after = open_bins[: capacity + 1 - s].copy()
        before = open_bins[s:]
        change = 2 * (after - before) + 2
        change[:least] = 1 - 2 * before[:least]
        change[before == 0] = far
        best = int(change.argmin())
        fresh = 2 * int(open_bins[capacity - s]) + 1 if capacity - s >= least else 0
        if change[best] <= fresh:
            gap = best + s
            b = held[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b = capacity, next(made)
        where[i], offset[i] = b, capacity - gap
        if gap - s >= least:
            held[gap - s].append(b)
            open_bins[gap - s] += 1
    return where, offset


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY, block: int = BLOCK, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to pieces with a column length of 1 to capacity.

    documents: how many there are, for the number of blocks.  Blocks hold about ``block`` documents whatever the input.
    """
    blocks = max(1, -(-documents // block))
    # the row's place in its task keeps equal rows from meeting in one block
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64(*order, "length", F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    names = pieces.columns

    def packed(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("length", "descending"), *((c, "ascending") for c in order)])).combine_chunks()
        bins, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        sequence = (table.column("__block").to_numpy() << 32) + bins
        return table.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return dealt.groupBy("__block").applyInArrow(packed, schema)


def best_fit(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(tokenized(docs, capacity, path), docs.count(), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_ids whose pieces they hold, in order."""
    placed = pack(tokenized(docs, capacity, path, tokens=True), docs.count(), capacity)
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity pieces
    return placed.groupBy("sequence_id").agg(inside.alias("inside")).select("sequence_id", F.flatten(F.col("inside.ids")).alias("ids"), F.col("inside.doc_id").alias("doc_ids"))
