"""SimHash near-duplicates with a pigeonring filter.

``fingerprints`` hashes the shingles of every whole text and keeps each bit that over half of them set.  Documents with
one fingerprint are one node from there on.  64 bits are a ring of 4 segments of 16.  If two fingerprints differ in at
most 3 bits, there is a segment from which every chain of l consecutive segments differs in at most floor(3 l / 4) bits
(the strong pigeonhole principle on a ring): 0 in the first, 1 in two, 2 in three.  So a candidate shares a segment
whole, and 3 of the 4 nibbles of the next: a key of 28 bits, 16 keys for each fingerprint.  Within a key the chain's
budgets are checked one length after another, and the full Hamming distance last.

A key held by up to ``HOT`` fingerprints is compared within itself, and only a spanning forest of its links is
emitted.  Fingerprints of larger keys (one huge cloud of near copies) take an exact way that is linear in their number:
two are within 3 bits just if some value is within 1 bit of one and 2 of the other, so all that reach a value meet at
that value, and each is linked with the smallest that reaches it within 1 bit.

Defined cases: a null or empty text has no words and the fingerprint 0; fewer words than a shingle make one shingle;
repeated rows are linked; a null doc_id takes part but never names a component (which then is null if it has no other);
an empty table gives an empty result; other columns are ignored.

``deduplicate`` keeps one document of each group of copies and near copies, those whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more.  Such texts differ in more bits than 3 of one 64-bit fingerprint of shingles,
so it draws several independent fingerprints of the words, takes pairs that the pigeonring search links in any of them
as candidates, and with them all that share one of BANDS keys, each of four minima of the shingles' hashes: a pair at
0.8 shares none of them with a probability of 0.00003, whatever the texts' length.  Candidates are checked on the
shingles: by bottom-k sketches where these are exact (up to 256 shingles) or settle it (beyond, they have a standard
error of 0.025 at 0.8), else, within five standard errors of the limit, by the whole sets.

Only links that pass the check join trees.  In HUBS rounds the members of a key meet one of them, where they aren't in
its tree yet, which settles large groups in linear time; what is then still apart within a key is compared pair by pair
in the key's task, by the shared minima and then the sketches, and only links leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.components import components
from rostra.llm.common import stored, trimmed

SHINGLE = 3
DIFFER = 3
SEED = 42
SEGMENTS = 4
#: Fingerprints that one key may hold for a comparison within it.
HOT = 2048


def _digests(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of all shingles of a text, in order, as big-endian numbers; digests of 65,536 are held at once."""
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths)[: max(1, len(words) - width + 1)]
    last = ends[min(width, len(words)) - 1 :]
    out = np.empty(len(first), ">u8")
    digest = xxhash.xxh64_digest
    for at in range(0, len(first), 65_536):
        a, b = first[at : at + 65_536].tolist(), last[at : at + 65_536].tolist()
        out[at : at + 65_536] = np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)]), ">u8")
    return out


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64 bits of a text as a signed number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hashes = _digests(words, width).view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        count += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: trimmed(hashed(batches)), f"doc_id {kind}, fp long")


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: which segment and nibble, the segment, and the next one without the nibble."""
    keys = []
    for i in range(SEGMENTS):
        segment = F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(0xFFFF)
        after = F.shiftrightunsigned(fp, 48 - 16 * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for c in range(4):
            rest = after.bitwiseAND(0xFFFF ^ (0xF << (4 * c)))
            keys.append(F.shiftleft(F.shiftleft(F.lit(i * 4 + c).cast("long"), 16).bitwiseOR(segment), 16).bitwiseOR(rest))
    return F.array(*keys)


def chained(x: np.ndarray, segment: int, differ: int = DIFFER) -> np.ndarray:
    """Which of the differences x pass every chain from the segment on, and so the full check."""
    passed = np.ones(x.shape, dtype=bool)
    total = np.zeros(x.shape, dtype=np.uint8)
    for length in range(1, SEGMENTS + 1):
        shift = np.uint64(48 - 16 * ((segment + length - 1) % SEGMENTS))
        total = total + np.bitwise_count((x >> shift) & np.uint64(0xFFFF))
        passed &= total <= differ * length // SEGMENTS
    return passed


def forest(fps: np.ndarray, segment: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one key: pairs that pass every chain, larger first."""
    v = np.sort(fps).astype(np.int64)
    u = v.view(np.uint64)
    rows, cols = [], []
    for at in range(0, len(u), 512):
        i, j = np.nonzero(chained(u[at : at + 512, None] ^ u[None, :], segment))
        keep = i + at > j
        rows.append(i[keep] + at)
        cols.append(j[keep])
    a, b = np.concatenate(rows), np.concatenate(cols)
    label, out = np.arange(len(u)), []
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # every tree that has a link to one with a smaller root joins it, by one of its links
        tree, first = np.unique(np.maximum(x, y), return_index=True)
        out += [(int(v[i]), int(v[j])) for i, j in zip(a[first], b[first], strict=True)]
        parent = np.arange(len(u))
        parent[tree] = np.minimum(x, y)[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return out


def _within_keys(keyed: DataFrame) -> DataFrame:
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(key >> 40, *pair) for pair in forest(fps.values.to_numpy(), key >> 34 & 3)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["tag", "u", "v"])

    return keyed.mapInArrow(lambda batches: trimmed(linked(batches)), "tag long, u long, v long")


def _masks(bits: int) -> list[int]:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << b for b in c)) for c in combinations(range(64), bits)]


def _by_meeting(fps: DataFrame) -> DataFrame:
    """Links among fingerprints by the values within 2 bits of each: exact, and linear in their number."""
    masks = [m for r in (0, 1, 2) for m in _masks(r)]
    near = F.col("pos") < len(_masks(0)) + len(_masks(1))
    listed = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")  # one constant, not 2,081 expressions
    reach = fps.select("tag", "fp", F.posexplode(listed).alias("pos", "mask")).select("tag", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), near.alias("near"))
    # Per value the smallest near one, and whether another reaches it: sums that tasks form before they shuffle.
    met = reach.groupBy("tag", "at").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("to"), F.max("fp").alias("most"), F.min("fp").alias("least"))
    met = met.where("to is not null and most <> least").withColumnsRenamed({"at": "__at", "tag": "__tag"})
    return reach.join(met, (F.col("at") == F.col("__at")) & (F.col("tag") == F.col("__tag"))).where("fp <> to").select("tag", F.col("fp").alias("u"), F.col("to").alias("v")).distinct()


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """tag, u, v: links within 3 bits, enough to connect all distinct values of fp, of one tag, that chains of links connect."""
    key = F.explode(F.transform(_keys(F.col("fp")), lambda k: F.shiftleft("tag", 40).bitwiseOR(k)))
    keyed = fps.select("tag", "fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "__key")
    shared = stored(keyed.join(sizes, F.col("key") == F.col("__key")).select("key", "tag", "fp", "n"), "simhash-keys")
    few = shared.where(F.col("n") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    found = _within_keys(few)
    many = shared.where(F.col("n") > hot).select("tag", "fp").distinct()
    return found.unionByName(_by_meeting(many)) if many.take(1) else found


def near_duplicates(docs: DataFrame, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links) of every document."""
    rows = stored(fingerprints(docs, width), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(nodes.select(F.lit(0).cast("long").alias("tag"), "fp"), hot).select("u", "v"))
    rooted = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    named = rooted.groupBy(F.col("root").alias("__root")).agg(F.min("first").alias("component_id"))
    named = rooted.join(named, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- one document of each group ----------------------------------------------------------------------------------------

DRAWS = 6
SIMILAR = 0.8
WORDS_OF_A_SHINGLE = 5
SKETCH = 256
#: Estimates so near to the limit settle nothing: five standard errors.
UNSURE = 0.125
#: Numbers that a part of a mapped batch holds (8 MiB), beyond which it ends with its row.
MAPPED = 1 << 20
#: Up to so many rows that go are broadcast (24 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Keys of a text, of four minima each, and rounds in which the members of a key meet one of them.
BANDS = 20
HUBS = 3
#: Minima that similar texts must share before their sketches are compared: five standard errors below SIMILAR.
SHARED_MINIMA = int(4 * BANDS * (SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / (4 * BANDS)) ** 0.5))
_MINIMA = np.array([(0xD1342543DE82EF95 * (2 * t + 1)) % (1 << 64) for t in range(4 * BANDS)], dtype=np.uint64)
_DRAWN = np.array([(0x9E3779B97F4A7C15 * (2 * t + 1)) % (1 << 64) for t in range(DRAWS)], dtype=np.uint64)


def drawn(text: bytes | None) -> list[int]:
    """DRAWS fingerprints of a text's words, each word with the weight 1 + log2(its count)."""
    count = Counter((text or b"").lower().split())
    if not count:
        return [0] * DRAWS
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in count]), ">u8").astype(np.uint64)
    weight = 1 + np.log2(np.fromiter(count.values(), np.float64, len(count)))
    out = []
    for c in _DRAWN:
        x = (h ^ (h >> np.uint64(31))) * c
        x ^= x >> np.uint64(29)
        for_one = np.zeros(64)
        for at in range(0, len(x), 8192):
            for_one += weight[at : at + 8192] @ np.unpackbits(x[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int(np.packbits(2 * for_one > weight.sum()).view(">i8")[0]))
    return out


def shingles(text: bytes | None, width: int = WORDS_OF_A_SHINGLE) -> np.ndarray:
    """The hashes of a text's set of shingles, in order."""
    return np.unique(_digests((text or b"").lower().split() or [b""], width).astype(np.uint64).view(np.int64))


def banded(text: bytes | None) -> list[int]:
    """BANDS keys of a text, each the last 16 bits of four minima of its shingles' hashes."""
    h = shingles(text).view(np.uint64)
    h = h ^ (h >> np.uint64(31))
    low = np.empty(len(_MINIMA), np.uint16)
    for k, c in enumerate(_MINIMA):
        x = h * c
        low[k] = (x ^ (x >> np.uint64(29))).min() & np.uint64(0xFFFF)
    return low.view(np.int64).tolist()


def sketch(text: bytes | None, width: int = WORDS_OF_A_SHINGLE, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest hashes of a text's set of shingles, in order."""
    return shingles(text, width)[:size]


def similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two sets from their sketches."""
    union = np.union1d(a, b)
    union = union[:size] if max(len(a), len(b)) >= size else union
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / max(1, len(union))


def _mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Apply f to each row's bytes in the last column; other columns stay.  A batch leaves in parts of about MAPPED numbers."""
    names = df.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values, held = batch.column(len(names)).cast(pa.binary()), [], 0
            for i in range(batch.num_rows):
                values.append(np.asarray(f(texts[i].as_py()), np.int64))
                held += len(values[-1])
                if held >= MAPPED or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    part = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(i + 1 - len(values), len(values)) for c in batch.columns[:-1]), part], [*names, "value"])
                    values, held = [], 0

    return df.mapInArrow(lambda batches: trimmed(run(batches)), ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), schema]))


def text_node() -> Column:
    """A text's number: equal for equal texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _apart(live: DataFrame, least: float) -> DataFrame:
    """u, v, unsure: links of nodes of one key (key, node, root, bands, hashes) that join different trees, where sketches
    settle it, and the pairs that they leave unsure.  Pairs that aren't similar go no further than their key's task."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                m = members.values
                node, root = m.field("node").to_numpy(), m.field("root").to_numpy().copy()
                low = m.field("bands").flatten().to_numpy().view(np.uint16).reshape(len(node), -1)
                hashes = [x.values.to_numpy() for x in m.field("hashes")]
                u, v, unsure = [], [], []
                for i in range(len(node) - 1):
                    j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                    for k in j[(low[j] == low[i]).sum(axis=1) >= SHARED_MINIMA].tolist():
                        if root[k] == root[i]:
                            continue
                        guess = similarity(hashes[i], hashes[k])
                        doubt = max(len(hashes[i]), len(hashes[k])) >= SKETCH and abs(guess - least) <= UNSURE
                        if doubt or guess >= least:
                            u.append(min(node[i], node[k]))
                            v.append(max(node[i], node[k]))
                            unsure.append(doubt)
                        if not doubt and guess >= least:
                            root[root == root[k]] = root[i]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(unsure, pa.bool_())], ["u", "v", "unsure"])

    return live.groupBy("key").agg(F.collect_list(F.struct("node", "root", "bands", "hashes")).alias("m")).select("m").mapInArrow(lambda batches: trimmed(met(batches)), "u long, v long, unsure boolean").distinct()


def _checker(docs: DataFrame, asked: DataFrame, least: float) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, Callable[[DataFrame], DataFrame]]:
    """What gives, of pairs (u, v) of the asked nodes, those whose texts are similar; their sketches; and of what was
    found (u, v, unsure) the sure pairs and those of the others that are similar by their whole sets."""
    held = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = docs.select(text_node().alias("node"), "text").join(held, F.col("node") == F.col("__node"), "left_semi")
    made = stored(_mapped(texts, sketch, "hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")), "drawn-sketches")
    s1, s2 = (made.select(F.col("node").alias(f"n{k}"), F.col("hashes").alias(f"h{k}")) for k in (1, 2))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            sketches = [(a[i].values.to_numpy(), b[i].values.to_numpy()) for i in range(batch.num_rows)]
            guess = np.array([similarity(x, y) for x, y in sketches], dtype=np.float64)
            cut = np.array([max(len(x), len(y)) >= SKETCH for x, y in sketches], dtype=bool)
            unsure = cut & (np.abs(guess - least) <= UNSURE)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unsure)], ["u", "v", "unsure"])
            yield out.filter(pa.array(unsure | (guess >= least)))

    def whole(pairs: DataFrame) -> DataFrame:
        """Of pairs, those whose whole sets of shingles are similar."""
        ids = stored(pairs.select(F.col("u").alias("__node")).unionByName(pairs.select(F.col("v").alias("__node"))).distinct(), "drawn-unsure")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        long = docs.select(text_node().alias("node"), "text").join(ids, F.col("node") == F.col("__node"), "left_semi")
        sets = stored(_mapped(long.dropDuplicates(["node"]), shingles, "hashes array<long>"), "drawn-shingles")
        w1, w2 = (sets.select(F.col("node").alias(f"n{k}"), F.col("hashes").alias(f"h{k}")) for k in (1, 2))
        both = pairs.join(w1, F.col("u") == F.col("n1")).join(w2, F.col("v") == F.col("n2"))
        common = F.size(F.array_intersect("h1", "h2"))
        return both.where(common / (F.size("h1") + F.size("h2") - common) >= least).select("u", "v")

    def check(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(s1, F.col("u") == F.col("n1")).join(s2, F.col("v") == F.col("n2")).select("u", "v", "h1", "h2")
        return settled(stored(joined.mapInArrow(lambda batches: trimmed(checked(batches)), "u long, v long, unsure boolean"), "drawn-checked"))

    def settled(found: DataFrame) -> DataFrame:
        clear, unsure = found.where("not unsure").select("u", "v"), found.where("unsure").select("u", "v")
        return clear.unionByName(whole(unsure)) if unsure.take(1) else clear

    return check, made, settled


def similar(docs: DataFrame, least: float = SIMILAR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of docs, and links (u, v) of nodes whose texts are similar, enough to connect their groups."""
    rows = stored(_mapped(docs.select("doc_id", text_node().alias("node"), "text"), lambda t: drawn(t) + banded(t), "fps array<long>"), "drawn")
    nodes = stored(rows.groupBy("node").agg(F.first("fps").alias("fps")), "drawn-nodes")
    # what the pigeonring links
    each = nodes.select("node", F.posexplode(F.slice("fps", 1, DRAWS)).alias("tag", "fp")).withColumn("tag", F.col("tag").cast("long"))
    named = stored(each.groupBy("tag", "fp").agg(F.min("node").alias("name")), "drawn-names")
    n1, n2 = (named.select(F.col("tag").alias(f"t{k}"), F.col("fp").alias(f"f{k}"), F.col("name").alias(x)) for k, x in ((1, "u"), (2, "v")))
    alike = each.join(n1, (F.col("tag") == F.col("t1")) & (F.col("fp") == F.col("f1"))).select(F.col("node").alias("v"), "u")
    near = links(named.select("tag", "fp"), hot).select("tag", F.col("u").alias("a"), F.col("v").alias("b"))
    near = near.join(n1, (F.col("tag") == F.col("t1")) & (F.col("a") == F.col("f1"))).join(n2, (F.col("tag") == F.col("t2")) & (F.col("b") == F.col("f2")))
    drawn_pairs = alike.select("u", "v").unionByName(near.select("u", "v")).where("u <> v")
    drawn_pairs = stored(drawn_pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "drawn-pairs")
    # what shares a key of minima
    bands = nodes.select("node", F.slice("fps", DRAWS + 1, BANDS).alias("bands"))
    keyed = bands.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "__key")
    members = stored(keyed.join(sizes, F.col("key") == F.col("__key")).select("key", "node", "n"), "drawn-members")
    asked = drawn_pairs.select(F.col("u").alias("__node")).unionByName(drawn_pairs.select(F.col("v").alias("__node"))).unionByName(members.select(F.col("node").alias("__node")))
    check, sketches, settled = _checker(docs, stored(asked.distinct(), "drawn-asked"), least)

    linked, live = check(drawn_pairs), members
    for turn in range(HUBS + 1):
        roots = components(linked).withColumnRenamed("node", "__node")
        live = live.select("key", "node", "n").join(roots, F.col("node") == F.col("__node"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        met = F.max(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("hub"), F.col("root").alias("hub_root"))).alias("hub")
        hubs = live.groupBy(F.col("key").alias("__key")).agg(met, F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("__key", "hub.hub", "hub.hub_root")
        live = stored(live.join(hubs, F.col("key") == F.col("__key")).drop("__key"), "drawn-live")
        if not live.take(1):
            break
        if turn < HUBS:
            pairs = live.where("root <> hub_root").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
            live = live.where("n > 2")  # the members of others have all met
        else:
            held = live.join(bands.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).drop("__node")
            held = held.join(sketches.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"))
            linked = stored(linked.unionByName(settled(stored(_apart(held, least), "drawn-apart"))), "drawn-linked")
            break
        linked = stored(linked.unionByName(check(stored(pairs, "drawn-pairs"))), "drawn-linked")
    return rows.select("doc_id", "node"), linked


def deduplicate(docs: DataFrame, least: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """The rows of docs without those that repeat or nearly repeat another; of each group that with the smallest doc_id stays."""
    rows, linked = similar(docs, least, hot)
    roots = components(linked)
    own = rows.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    own = stored(own.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", "doc_id", "rows", F.coalesce("root", "node").alias("root")), "dedup")
    first = own.groupBy(F.col("root").alias("__root")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    marked = own.join(first, F.col("root") == F.col("__root")).select(F.col("node").alias("__node"), F.col("doc_id").alias("__doc_id"), stays.alias("__stays"), "rows")
    marked = stored(marked.where(~F.col("__stays") | (F.col("rows") > 1)).drop("rows"), "dedup-marked")
    table = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    columns = docs.columns
    seen = docs.withColumn("__own", text_node()).join(table, (F.col("__own") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left")
    out = seen.where("__stays is null").select(*columns)
    if marked.where("__stays").take(1):  # of several equal rows with one id, one
        out = out.unionByName(seen.where("__stays").dropDuplicates(["__own", "doc_id"]).select(*columns))
    return out
