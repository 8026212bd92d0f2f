"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id, so copies of one vector spread over all shards.  In a shard equal
vectors are one node with many ids.  Vectors get one more component that lifts all to the same length, which turns the
largest inner product into the nearest vector.  A graph is built layer by layer from the top, in batches: a batch
searches what stands, compares itself with itself, keeps diverse neighbours, and links back with pruning.  It is stored
as flat arrays in one row per shard: vectors, ids, and for each layer its nodes and their neighbours, padded with -1.
Searching sends each query to every shard, walks down the layers and keeps a beam; the beam's vectors are scored in double
precision, and the shards' best are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
no part; of rows with one id the smallest vector counts; vectors of different lengths are indexed apart and never
compared; fewer candidates than asked for are all returned; ties go to the smaller id; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import stored

LINKS = 16  # of a node in the upper layers; twice as many in the lowest
BUILD_BEAM = 80
BEAM = 100
#: Rows of a shard on average, from so many rows on; below, there are MIN_SHARDS.
SHARD_ROWS = 65_536
MIN_SHARDS = 8
#: Queries that one task takes to one shard, on average.
QUERY_BLOCK = 16_384


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in falling order of similarity (-1: none), up to ``most`` that are nearer to their owner than to
    any chosen before them; free places go to the nearest of the rest."""
    rows, width = ids.shape
    out = np.full((rows, most), -1, np.int32)
    for at in range(0, rows, 256):
        s, k = sims[at : at + 256], ids[at : at + 256]
        v = x[np.maximum(k, 0)]
        between = v @ v.swapaxes(1, 2)
        valid = k >= 0
        chosen = np.zeros(k.shape, bool)
        nearest = np.full(k.shape, -np.inf, np.float32)  # to a chosen one
        count = np.zeros(len(k), np.int64)
        for c in range(width):
            take = valid[:, c] & (s[:, c] > nearest[:, c]) & (count < most)
            chosen[:, c] = take
            count += take
            np.maximum(nearest, np.where(take[:, None], between[:, c, :], -np.inf), out=nearest)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        picked = np.take_along_axis(k, order, 1)
        out[at : at + 256, : picked.shape[1]] = picked
    return out


def _beam(x: np.ndarray, q: np.ndarray, entry: np.ndarray, links: np.ndarray, place: np.ndarray | None, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """ids and similarities of the ``width`` best nodes found from the entries, in falling order (-1: none).

    place: row of links of each node, where links holds some nodes only.
    """
    n, b = len(x), len(q)
    ids = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("bd,bd->b", q, x[entry]), False
    seen = np.zeros((b, n), bool)
    seen[np.arange(b), entry] = True
    live = np.arange(b)
    while len(live):
        best = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-best, min(step, width) - 1, axis=1)[:, :step] if width > step else np.argsort(-best, axis=1)
        good = np.take_along_axis(best, pick, 1) > -np.inf
        going = good.any(1)
        live, pick, good = live[going], pick[going], good[going]
        if not len(live):
            break
        from_ = np.where(good, ids[live[:, None], pick], -1)
        done[live[:, None], pick] = True
        row = from_ if place is None else np.where(from_ >= 0, place[from_], -1)
        near = np.where(row[:, :, None] >= 0, links[row], -1).reshape(len(live), -1)
        near.sort(axis=1)  # a node may be reached from two at once
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[live[:, None], near]
        r, c = np.nonzero(new)
        hit = near[r, c]
        seen[live[r], hit] = True
        value = np.full(near.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("bd,bd->b", q[live[r]], x[hit])
        all_sims = np.concatenate([sims[live], value], 1)
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], 1)
        all_done = np.concatenate([done[live], ~new], 1)
        order = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live], ids[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_sims, all_ids, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _connect(x: np.ndarray, nodes: np.ndarray, links: np.ndarray, place: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Link the nodes ``new`` with the best of their candidates, and those back."""
    most = links.shape[1]
    mine = _diverse(sims, ids, x, most if len(nodes) <= most + 1 else max(most // 2, LINKS))
    links[place[new], : mine.shape[1]] = mine
    links[place[new], mine.shape[1] :] = -1
    r, c = np.nonzero(mine >= 0)
    to, back = mine[r, c], new[r]
    value = np.einsum("bd,bd->b", x[to], x[back])
    order = np.lexsort((back, -value, to))
    to, back, value = to[order], back[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, int)
    owner = to[first]
    nth = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    keep = nth < most
    extra = np.full((len(owner), most), -1, np.int32)
    extra[np.repeat(np.arange(len(owner)), np.diff(np.append(first, len(to))))[keep], nth[keep]] = back[keep]
    for at in range(0, len(owner), 1024):
        o = owner[at : at + 1024]
        k = np.concatenate([links[place[o]], extra[at : at + 1024]], 1)
        k = np.sort(k, axis=1)
        k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
        s = np.where(k >= 0, np.einsum("bd,bkd->bk", x[o], x[np.maximum(k, 0)]), -np.inf).astype(np.float32)
        order = np.argsort(-s, axis=1, kind="stable")
        k, s = np.take_along_axis(k, order, 1), np.take_along_axis(s, order, 1)
        many = (k >= 0).sum(1) > most
        links[place[o[~many]]] = k[~many][:, :most]
        if many.any():
            links[place[o[many]]] = _diverse(s[many], k[many], x, most)


def build(x: np.ndarray, seed: int = 0, links: int = LINKS, beam: int = BUILD_BEAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """From lifted float32 vectors, all different: for each layer from the top, its nodes and their neighbours."""
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable").astype(np.int32)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for layer in range(int(level.max(initial=0)), -1, -1):
        nodes = order[level[order] >= layer]
        most = links * (2 if layer == 0 else 1)
        near = np.full((len(nodes), most), -1, np.int32)
        place = np.full(len(x), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        start, size = 0, 256
        while start < len(nodes):
            new = nodes[start : start + size]
            inside = x[new] @ x[new].T
            np.fill_diagonal(inside, -np.inf)
            width = min(beam // 2, len(new) - 1)
            top = np.argpartition(-inside, max(width - 1, 0), axis=1)[:, :width] if width else np.zeros((len(new), 0), int)
            ids, sims = new[top].astype(np.int32), np.take_along_axis(inside, top, 1)
            if start:
                entry = _descend(x, x[new], layers, nodes[:1])
                parts = [_beam(x, x[new[a : a + 256]], entry[a : a + 256], near, place, beam) for a in range(0, len(new), 256)]
                ids = np.concatenate([np.concatenate([p[0] for p in parts]), ids], 1)
                sims = np.concatenate([np.concatenate([p[1] for p in parts]), sims], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            _connect(x, nodes, near, place, new, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1))
            start += len(new)
            size = min(start, 2048)
        layers.append((nodes, near))
    return layers


def _descend(x: np.ndarray, q: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray) -> np.ndarray:
    """The nearest node to each query that a walk down the layers finds."""
    entry = np.repeat(layers[0][0][:1] if layers else first, len(q))
    for nodes, near in layers:
        place = np.full(len(x), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        for at in range(0, len(q), 512):
            entry[at : at + 512] = _beam(x, q[at : at + 512], entry[at : at + 512], near, place, 4)[0][:, 0]
    return entry


def search(x: np.ndarray, q: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int = BEAM) -> np.ndarray:
    """Nodes found for each lifted query, in falling order of similarity (-1: none)."""
    entry = _descend(x, q, layers[:-1], layers[-1][0][:1])
    nodes, near = layers[-1]
    place = np.full(len(x), -1, np.int32)
    place[nodes] = np.arange(len(nodes))
    step = max(1, min(256, (32 << 20) // max(1, len(x))))
    return np.concatenate([_beam(x, q[a : a + step], entry[a : a + step], near, place, min(beam, max(len(x), 1)))[0] for a in range(0, len(q), step)])


def lifted(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors scaled to at most length 1, with the component that makes each exactly so; and the scale."""
    scale = float(np.abs(v).max(initial=0)) or 1.0
    u = v / scale
    length = np.sqrt((u * u).sum(1))
    most = float(length.max(initial=0)) or 1.0
    u, length = u / most, length / most
    return np.concatenate([u, np.sqrt(np.maximum(0, 1 - length * length))[:, None]], 1).astype(np.float32), scale * most


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    odd = F.exists(v, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda c: c != 0), F.lit(False))


_INDEX = "dim int, shard int, ids array<long>, ends array<int>, vectors array<double>, nodes array<array<int>>, neighbours array<array<int>>"


def index(rows: DataFrame, shards: int | None = None, links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """From vec_id and embedding, a row per shard and vector length: its graph in flat arrays."""
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    n = shards or max(MIN_SHARDS, -(-good.count() // SHARD_ROWS))
    dealt = good.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard"))

    def graph(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v, ids = np.stack(frame["embedding"].to_numpy()), frame["vec_id"].to_numpy()
        order = np.lexsort((*v.T[::-1], ids))
        v, ids = v[order], ids[order]
        once = np.concatenate(([True], ids[1:] != ids[:-1]))
        v, ids = np.ascontiguousarray(v[once]), ids[once]
        _, first, inverse = np.unique(v.view(f"V{v.dtype.itemsize * v.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        by = np.lexsort((ids, inverse))
        ends = np.cumsum(np.bincount(inverse, minlength=len(first)))
        v = v[first]
        layers = build(lifted(v)[0], int(key[1]), links, beam)
        row = (int(key[0]), int(key[1]), ids[by], ends.astype(np.int32), v.reshape(-1), [a for a, _ in layers], [b.reshape(-1) for _, b in layers])
        return pd.DataFrame([row], columns=["dim", "shard", "ids", "ends", "vectors", "nodes", "neighbours"])

    return dealt.groupBy("dim", "shard").applyInPandas(graph, _INDEX)


def nearest(indexed: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each query (vec_id, embedding), itself left out."""
    good = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").where(F.col("vec_id").isNotNull() & usable())
    good = good.groupBy("query_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding")).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-good.count() // QUERY_BLOCK))
    shards = indexed.select(F.col("dim").alias("__dim"), F.col("shard").alias("__shard"))
    sent = good.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(shards, F.col("dim") == F.col("__dim")).select("query_id", "embedding", "dim", F.col("__shard").alias("shard"), "block")
    held = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(graphs) or not len(asked):
            return empty
        g = graphs.iloc[0]
        v = np.asarray(g["vectors"], np.float64).reshape(-1, int(g["dim"]))
        ids, ends = np.asarray(g["ids"]), np.asarray(g["ends"])
        starts = np.concatenate(([0], ends[:-1]))
        layers = [(np.asarray(a, np.int32), np.asarray(b, np.int32).reshape(len(a), -1)) for a, b in zip(g["nodes"], g["neighbours"], strict=True)]
        q = np.stack(asked["embedding"].to_numpy())
        x, _ = lifted(v)
        length = np.sqrt(((q / np.abs(q).max(1, keepdims=True)) ** 2).sum(1)) * np.abs(q).max(1)
        unit = np.concatenate([q / length[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
        nodes = search(x, unit, layers, beam)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, own in enumerate(asked["query_id"].to_numpy()):
            hit = nodes[i][nodes[i] >= 0]
            score = (v[hit] * q[i]).sum(1)
            some = [ids[starts[h] : min(ends[h], starts[h] + k + 1)] for h in hit]  # more copies of one vector can't be among k
            near, value = np.concatenate(some), np.repeat(score, [len(s) for s in some])
            near, value = near[near != own], value[near != own]
            best = np.lexsort((near, -value))[:k]
            out.append((np.full(len(best), own), near[best], value[best]))
        return pd.DataFrame({name: np.concatenate([o[c] for o in out]) for c, name in enumerate(("query_id", "vec_id", "score"))})

    keys = ["dim", "shard", "block"]
    hits = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Index all rows, and search those whose id is divisible by ``every``."""
    graphs = stored(index(rows), "hnsw")
    return nearest(graphs, rows.where(F.col("vec_id") % every == 0), k)
