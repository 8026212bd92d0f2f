"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of a text, so an n-gram of up to six is one number, exactly.  Every n-gram of every trusted text is
counted: tasks pre-aggregate, a shuffle shards the sums by n-gram, and each lower order follows from the one above (raw
sums, and continuation counts: how many different symbols precede).  Counts join their contexts' sums, sharded by
context, which gives the discounted probabilities; what the discounts free goes to the order below.  No n-gram is left
out, and neither the model nor the documents' n-grams come to the driver or are broadcast.

Documents are scored by a join of their n-grams with the sharded model.  Shards are ranges of the context read backwards,
cut so that each holds about PART_ROWS n-grams; an n-gram of a lower order belongs to every shard whose range lies in its
own context's, so that all a symbol falls back to is in one shard.  Texts are dealt to chunks of about CHUNK_BYTES.  A
chunk sends each n-gram it holds once to its shard, where the model answers with the logarithm of the last symbol's
probability, and the answers meet the chunk's texts again, which sums them by document.  So the work and what is shuffled
grow with the input only, a frequent n-gram is one row a chunk, and a task holds one shard and one chunk at a time.

``classified`` gives each document's log perplexity per symbol, and keeps it up to a fence of its language: the upper
quartile of held-out trusted texts plus FENCE interquartile ranges, and further for short texts, whose means vary more.
Held out is a quarter of the trusted texts by a hash of the text; a model of the others scores it, so that its values
are those of good texts that the model doesn't know, and bad documents have no part in the fence.  A language with
fewer than HELD_TEXTS of them has no such sample: its fence comes from all its documents, at WIDE interquartile ranges.
Low values are never a fault: copies of trusted texts have them.

Defined cases: a null or empty text has no symbols, perplexity 1 and is not kept; a text longer than a chunk is a chunk
of its own, worked through in runs; null languages are one language; repeated rows count and are judged each, and equal
texts have equal values; without trusted text every byte has probability 1/256 and nothing is rejected; labels without an
id or quality are ignored; an empty table gives an empty result; other columns are ignored or kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import forget, stored, trim, trimmed

ORDER = 6
#: N-grams of the highest order in one shard of the model, which is what a Python worker holds at a time.
PART_ROWS = 400_000
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
FENCE = 3.0
#: Where a language has fewer held-out texts than HELD_TEXTS, of all its documents.
WIDE = 10.0
HELD_TEXTS = 10
#: Texts of so many symbols get a fence twice as far from the median as very long ones.
SHORT = 200
#: Up to so many trusted ids are broadcast (16 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_CHUNK = 1 << 20
_NONE = np.float32(1)  # no logarithm of a probability


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, each after order - 1 zero bytes, and where each one's symbols are: n-gram keys, and text numbers (-1 in padding)."""
    pad = bytes(order - 1)
    line = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.full(len(line), -1, np.int64)
    if len(texts):
        starts = np.cumsum(lengths + order - 1) - lengths
        at = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        owner[at] = np.repeat(np.arange(len(texts)), lengths)
    key = line.astype(np.int64)
    for back in range(1, order):
        key[back:] |= line[:-back].astype(np.int64) << (8 * back)
    return key, owner


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column in runs of about _CHUNK bytes (a longer one alone), with the first one's place."""
    run, size, first = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary())):
        b = t.as_py() or b""
        if run and size + len(b) > _CHUNK:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def top_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and raw (how often it occurs) of the highest order, over the column text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([sums, *(f[1] for f in fresh)])
            by = np.argsort(k, kind="stable")
            k, c = k[by], c[by]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
            return k[first], np.add.reduceat(c, first) if len(k) else c

        for batch in batches:
            for _, run in _chunks(batch.column(0)):
                key, owner = _joined(run, order)
                fresh.append(np.unique(key[owner >= 0], return_counts=True))
                held += len(fresh[-1][0])
                if held > 2_000_000:
                    keys, sums = merged()
                    fresh, held = [], 0
                    if len(keys) > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["gram", "raw"])
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        for at in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(sums[at : at + 100_000])], ["gram", "raw"])

    return texts.select("text").mapInArrow(lambda batches: trimmed(counted(batches)), "gram long, raw long").groupBy("gram").agg(F.sum("raw").alias("raw"))


def all_orders(top: DataFrame, order: int = ORDER) -> DataFrame:
    """n, gram, raw and a (the count that Kneser-Ney uses: raw in the highest order, else continuations) of all n-grams."""
    level = top.select("gram", "raw", F.col("raw").alias("a"))
    out = level.select(F.lit(order).alias("n"), "gram", "raw", "a")
    for n in range(order - 1, 0, -1):
        below = F.col("gram").bitwiseAND((1 << (8 * n)) - 1).alias("gram")
        level = stored(level.groupBy(below).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("a")), f"grams-{n}")
        out = out.unionByName(level.select(F.lit(n).alias("n"), "gram", "raw", "a"))
    return out


def discounts(counts: list[int]) -> list[float]:
    """For counts 1, 2 and 3 or more, from how many n-grams have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2 or not n3:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


@dataclass
class Model:
    """A hash table of n-grams: key (order and n-gram), ln of its probability, and ln of the share it leaves as a context."""

    order: int
    keys: np.ndarray
    prob: np.ndarray
    left: np.ndarray
    floor: float  # probability of a symbol that no order holds

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places of keys in the table, or -1."""
        mask = len(self.keys) - 1
        at = (_mixed(key) & np.uint64(mask)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (found != -1)]
            at[todo] = (at[todo] + 1) & mask
        return out

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """ln P of the last symbol of each n-gram of the full order after the others."""
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        for n in range(self.order, 0, -1):
            gram = key[todo] & ((1 << (8 * n)) - 1)
            at = self.find(gram | (n << 48))
            hit = (at >= 0) & (self.prob[at] != _NONE)
            out[todo[hit]] += self.prob[at[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                return out
            context = self.find((gram >> 8) | ((n - 1) << 48))
            known = context >= 0
            out[todo[known]] += self.left[context[known]]
        out[todo] += self.floor
        return out


def _mixed(key: np.ndarray) -> np.ndarray:
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _table(order: int, keys: np.ndarray, prob: np.ndarray, left: np.ndarray, floor: float) -> Model:
    size = 1 << max(4, int(np.ceil(np.log2(2.2 * max(1, len(keys))))))
    slots, where = np.full(size, -1, np.int64), np.zeros(len(keys), np.int64)
    at = (_mixed(keys) & np.uint64(size - 1)).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        free = todo[slots[at[todo]] == -1]
        _, first = np.unique(at[free], return_index=True)
        put = free[first]
        slots[at[put]] = keys[put]
        where[put] = at[put]
        done = np.zeros(len(keys), bool)
        done[put] = True
        todo = todo[~done[todo]]
        at[todo] = (at[todo] + 1) & (size - 1)
    p, m = np.zeros(size, np.float32), np.zeros(size, np.float32)
    p[where], m[where] = prob, left
    return Model(order, slots, p, m, floor)


def fitted(texts: DataFrame, order: int = ORDER) -> DataFrame | None:
    """n, gram and own (the discounted probability) of every n-gram of a column text, or None without any."""
    grams = all_orders(stored(top_counts(texts, order), "grams-top"), order)
    of = [F.sum((F.col("a") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)]
    known = {r["n"]: r for r in grams.groupBy("n").agg(*of).collect()}  # a row for each order
    if not known:
        forget(grams)
        return None
    d = {n: discounts([r[f"n{k}"] for k in range(1, 5)]) for n, r in known.items()}
    by_order = F.element_at(F.array(*[F.array(*map(F.lit, d[n])) for n in range(1, order + 1)]), F.col("n"))
    less = F.element_at(by_order, F.least(F.col("a"), F.lit(3)).cast("int"))
    # Counts meet the sums of their contexts, sharded by order and context: 256 rows at most.
    total = F.sum("a").over(Window.partitionBy("n", F.shiftright("gram", 8)))
    own = stored(grams.select("n", "gram", ((F.col("a") - less) / total).alias("own")), "grams-own")
    forget(grams)
    return own


def backwards(gram: np.ndarray, n: int, order: int = ORDER) -> np.ndarray:
    """The contexts of n-grams read backwards, as the first of the numbers that contexts of the full order with that end have."""
    out = np.zeros(len(gram), np.int64)
    for i in range(n - 1):
        out |= (gram >> (8 * (i + 1)) & 0xFF) << (8 * (order - 2 - i))
    return out


def cuts(rows: DataFrame, order: int = ORDER, size: int | None = None) -> np.ndarray:
    """Where shards of the model begin, the first one's 0 left out: quantiles of the contexts read backwards."""
    top = rows.where(F.col("n") == order)
    shards = max(1, -(-top.count() // (size or PART_ROWS)))
    if shards == 1:
        return np.zeros(0, np.int64)
    terms = [F.shiftleft(F.shiftright("gram", 8 * (i + 1)).bitwiseAND(0xFF), 8 * (order - 2 - i)) for i in range(order - 1)]
    key = sum(terms[1:], terms[0])
    found = top.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0]
    return np.unique(np.array(found, np.int64))


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, then all second ones), compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(body: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(body, decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _squeezed(grams: np.ndarray) -> bytes:
    """Rising numbers in few bytes: how many, and their differences."""
    return struct.pack("<q", len(grams)) + _packed(np.diff(grams, prepend=0))


def _spread(body: bytes) -> np.ndarray:
    return np.cumsum(_numbers(body[8:], struct.unpack_from("<q", body)[0], np.int64))


_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_MODEL = -1  # the chunk of rows that hold the model


def _rows(part: list[int], chunk: list[int], body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary())], schema=_SENT)


def dealt(rows: DataFrame, starts: np.ndarray, order: int = ORDER) -> DataFrame:
    """part, chunk (_MODEL) and body: the model's n-grams, each in every shard that may need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gram, own = (batch.column(k).to_numpy() for k in range(3))
            first, last = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for k in range(1, order + 1):
                at = np.flatnonzero(n == k)
                low = backwards(gram[at], k, order)
                first[at] = np.searchsorted(starts, low, "right")
                last[at] = np.searchsorted(starts, low + (1 << (8 * (order - k))) - 1, "right")
            times = last - first + 1
            row = np.repeat(np.arange(len(n)), times)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            by = np.argsort(part, kind="stable")
            row, part = row[by], part[by]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            pieces = [row[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            body = [n[p].astype(np.int8).tobytes() + gram[p].tobytes() + own[p].tobytes() for p in pieces]
            yield _rows(part[ends - 1].tolist(), [_MODEL] * len(body), body)

    return rows.select("n", "gram", "own").mapInArrow(lambda batches: trimmed(run(batches)), "part int, chunk long, body binary")


def chunked(docs: DataFrame, names: list[str]) -> DataFrame:
    """chunk and body: the columns ``names`` (text last) in chunks of about CHUNK_BYTES of text, compressed.

    A chunk's number is its task's and its place there, so a task that is run again makes the same chunks.
    """
    size = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, bytes_held = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

        for batch in batches:
            lengths = np.array([0 if not t.is_valid else t.as_buffer().size for t in batch.column(batch.num_columns - 1)], np.int64)
            at = 0
            for i, n in enumerate(lengths.tolist()):
                if bytes_held + n > size and (held or i > at):
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield made()
                    number, held, bytes_held, at = number + 1, [], 0, i
                bytes_held += n
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield made()

    return docs.select(*names).mapInArrow(lambda batches: trimmed(run(batches)), "chunk long, body binary")


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


def _windows(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-gram keys of about _CHUNK symbols at a time, and the text of each; a long text is cut, each run with its context."""
    run, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), _CHUNK):
            piece = t[max(0, a - order + 1) : a + _CHUNK]
            run.append((piece, min(a, order - 1)))
            numbers.append(i)
            size += len(piece)
            if size >= _CHUNK:
                yield _keys(run, numbers, order)
                run, numbers, size = [], [], 0
    if run:
        yield _keys(run, numbers, order)


def _keys(run: list[tuple[bytes, int]], numbers: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    key, owner = _joined([p for p, _ in run], order)
    for k, (_, ahead) in enumerate(run):
        if ahead:  # symbols that only give context
            owner[np.flatnonzero(owner == k)[:ahead]] = -1
    inside = owner >= 0
    return key[inside], np.array(numbers, np.int64)[owner[inside]]


def _texts(table: pa.Table) -> list[bytes]:
    return [t.as_py() or b"" for t in table.column(table.num_columns - 1).cast(pa.binary())]


def asked(chunks: DataFrame, starts: np.ndarray, order: int = ORDER) -> DataFrame:
    """part, chunk and body: the different n-grams of each chunk's texts, by the shard that knows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                grams, fresh, held = np.zeros(0, np.int64), [], 0
                for key, _ in _windows(_texts(_unpacked(body.as_py())), order):
                    fresh.append(np.unique(key))
                    held += len(fresh[-1])
                    if held > 2_000_000:
                        grams, fresh, held = np.unique(np.concatenate([grams, *fresh])), [], 0
                grams = np.unique(np.concatenate([grams, *fresh]))
                fresh = []
                part = np.searchsorted(starts, backwards(grams, order, order), "right").astype(np.int32)
                by = np.argsort(part, kind="stable")
                part = part[by]
                ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(by) else []
                pieces = [by[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(by) else []
                out = _rows([int(part[e - 1]) for e in ends], [chunk] * len(pieces), [_squeezed(grams[p]) for p in pieces])
                del grams, part, by, pieces
                yield out

    return chunks.mapInArrow(lambda batches: trimmed(run(batches)), "part int, chunk long, body binary")


def answered(sent: DataFrame, order: int = ORDER) -> DataFrame:
    """part, chunk and body: each request's n-grams with the logarithms of their last symbols' probabilities.

    Rows of a shard come together, the model's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, model = None, [], None
        for batch in batches:
            for part, chunk, body in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                if part != now:
                    now, pieces, model = part, [], None
                    trim()
                raw = body.as_py()
                if chunk == _MODEL:
                    pieces.append(raw)
                    continue
                if model is None:
                    model, pieces = interpolated(order, *_columns(pieces)), []
                values = model.log_probabilities(_spread(raw)).astype(np.float32)
                yield _rows([part], [chunk], [struct.pack("<q", len(raw)) + raw + _packed(values)])
        now, pieces, model = None, [], None
        trim()

    return sent.mapInArrow(run, "part int, chunk long, body binary")


def _columns(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = [len(p) // 17 for p in pieces]
    n = [np.frombuffer(p, np.int8, k) for p, k in zip(pieces, counts, strict=True)]
    gram = [np.frombuffer(p, np.int64, k, k) for p, k in zip(pieces, counts, strict=True)]
    own = [np.frombuffer(p, np.float64, k, 9 * k) for p, k in zip(pieces, counts, strict=True)]
    return tuple(np.concatenate([np.zeros(0), *x]).astype(t) for x, t in ((n, np.int64), (gram, np.int64), (own, np.float64)))


def _answers(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams, values = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for body in bodies:
        (k,) = struct.unpack_from("<q", body)
        grams.append(_spread(body[8 : 8 + k]))
        values.append(_numbers(body[8 + k :], len(grams[-1]), np.float32))
    g, v = np.concatenate(grams), np.concatenate(values)
    by = np.argsort(g, kind="stable")
    return g[by], v[by]


def perplexities(docs: DataFrame, trained: DataFrame | None, keep: tuple[str, ...] = ("doc_id", "lang"), order: int = ORDER) -> DataFrame:
    """The columns ``keep``, n_symbols and log_ppl (mean of -ln P) of every row of docs, from its whole text.

    trained: what fitted() gives.
    """
    if trained is None:
        n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        return docs.select(*keep, n.alias("n_symbols"), F.when(n > 0, float(np.log(256))).otherwise(0.0).alias("log_ppl"))
    starts = cuts(trained, order)
    names = [*(k for k in dict.fromkeys(keep) if k != "text"), "text"]
    chunks = chunked(docs, names).repartition("chunk")
    sent = dealt(trained, starts, order).unionByName(asked(chunks, starts, order))
    shards = len(starts) + 1
    replies = answered(sent.repartitionById(shards, F.col("part")).sortWithinPartitions("part", "chunk"), order)
    kinds = {k: docs.schema[k].dataType.simpleString() for k in keep}

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, values = _answers(right.column("body").to_pylist())
        out = []
        for body in left.column("body").to_pylist():
            table = _unpacked(body)
            count, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
            for key, owner in _windows(_texts(table), order):
                found, inverse = np.unique(key, return_inverse=True)
                at = np.searchsorted(grams, found)
                if not len(grams) or (grams[np.minimum(at, len(grams) - 1)] != found).any():
                    raise ValueError("a chunk's answers lack n-grams of its texts")
                count += np.bincount(owner, minlength=table.num_rows)
                total -= np.bincount(owner, values[at][inverse], table.num_rows)
            cols = [table.column(k).combine_chunks() for k in keep]
            out.append(pa.Table.from_arrays([*cols, pa.array(count), pa.array(total / np.maximum(count, 1))], [*keep, "n_symbols", "log_ppl"]))
        del grams, values
        trim()
        return pa.concat_tables(out) if out else pa.table({})

    schema = ", ".join([*(f"`{k}` {t}" for k, t in kinds.items()), "n_symbols long, log_ppl double"])
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(summed, schema)


def interpolated(order: int, n: np.ndarray, gram: np.ndarray, own: np.ndarray) -> Model:
    """From the discounted probabilities of n-grams, prefixes and suffixes of all held: each with its full probability
    and the share that it leaves, as a context, to the order below."""
    lower: tuple[np.ndarray, np.ndarray] = (np.zeros(1, np.int64), np.array([1 / 256]))  # the order 0: any symbol alike
    keys, prob, left = [], [], []
    floor = 0.0
    for k in range(1, order + 1):
        g, p = gram[n == k], own[n == k]
        by = np.argsort(g)
        g, p = g[by], p[by]
        context = g >> 8
        held, inverse = np.unique(context, return_inverse=True)
        share = 1 - np.bincount(inverse, p, len(held))
        if k == 1:
            floor = float(np.log(max(share[0] if len(share) else 1.0, 1e-12) / 256))
            below = np.full(len(g), 1 / 256)
        else:
            below = lower[1][np.searchsorted(lower[0], g & ((1 << (8 * (k - 1))) - 1))]
            out = np.zeros(len(keys[-1]))
            real = np.isin(held, keys[-1])
            out[np.searchsorted(keys[-1], held[real])] = np.log(np.maximum(share[real], 1e-12))
            # a context of padding alone ends in no symbol, so it is no n-gram: its probability is marked as none
            keys[-1] = np.concatenate([keys[-1], held[~real]])
            prob[-1] = np.concatenate([prob[-1], np.full((~real).sum(), _NONE)])
            left.append(np.concatenate([out, np.log(np.maximum(share[~real], 1e-12))]))
        full = p + share[inverse] * below
        keys.append(g)
        prob.append(np.log(full))
        lower = (g, full)
    left.append(np.zeros(len(keys[-1])))
    tagged = np.concatenate([g | (k << 48) for k, g in enumerate(keys, 1)])
    return _table(order, tagged, np.concatenate(prob), np.concatenate(left), floor)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """__id of the documents whose best label is good."""
    best = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q"))
    return best.where("__q > 0").select("__id")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi")


def fences(values: DataFrame, fence: float = FENCE) -> DataFrame:
    """From lang and log_ppl of documents: lang, middle, high (the fence for long texts) and texts (how many)."""
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    out = values.groupBy("lang").agg(q.alias("q"), F.count(F.lit(1)).alias("texts"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.02))
    return out.select("lang", F.col("q")[1].alias("middle"), (F.col("q")[2] + spread * fence).alias("high"), "texts")


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), F.coalesce("text", F.lit(""))), F.lit(4)) == 0


def trusted_fences(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The fences of languages from lang and text of trusted documents, each different text once."""
    held = trusted.where(held_out()).select("lang", "text", F.xxhash64("text").alias("own"))
    rows = fitted(trusted.where(~held_out()).select("text"), order)
    values = stored(perplexities(held, rows, ("lang", "own"), order), "perplexity-held")
    if rows is not None:
        forget(rows)
    once = values.where("n_symbols > 0").groupBy("lang", "own").agg(F.first("log_ppl").alias("log_ppl"))
    return fences(once).where(F.col("texts") >= HELD_TEXTS)


def classified(docs: DataFrame, labels: DataFrame, order: int = ORDER, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` (doc_id and lang among them), n_symbols, log_ppl, high and kept of every document."""
    trusted = stored(only(docs, stored(trusted_ids(labels), "trusted")).select("lang", "text"), "trusted-texts")
    table = stored(trusted_fences(trusted, order), "fences-trusted")
    rows = fitted(trusted.select("text"), order)
    forget(trusted)
    values = stored(perplexities(docs, rows, keep, order), "perplexity")
    if rows is not None:
        forget(rows)
    rest = fences(values.where("n_symbols > 0").select("lang", "log_ppl"), WIDE)
    known = F.broadcast(table.select(F.col("lang").alias("__known")))  # a row for each language
    rest = rest.join(known, F.col("lang").eqNullSafe(F.col("__known")), "left_anti")
    return judged(values, table.unionByName(rest).drop("texts"))


def judged(values: DataFrame, table: DataFrame) -> DataFrame:
    table = stored(table.withColumnsRenamed({"lang": "__lang", "high": "__high"}), "fences")
    table = F.broadcast(table) if table.count() <= BROADCAST_IDS else table  # a row for each language
    joined = values.join(table, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    wide = 1 + F.sqrt(F.lit(float(SHORT)) / F.greatest(F.col("n_symbols"), F.lit(1)))
    joined = joined.withColumn("high", F.col("middle") + (F.col("__high") - F.col("middle")) * wide)
    kept = (F.col("n_symbols") > 0) & (F.col("log_ppl") <= F.col("high"))
    return joined.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("__lang", "middle", "__high")
