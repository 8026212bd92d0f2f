"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  A label is a shard; linked documents start where a hash of their id puts them.
Each round, a group's members wish to move to the shards that hold most of them (of equal ones, those that a hash of the
round prefers): one shard, or as many as the group needs.  Between each two shards as many members change places as wish
to in either direction, and beyond that a shard takes as many as it has room, so full shards take part and sizes stay
within their quotas.  Where nobody wishes to come back, groups that are whole in the wanted shard make place: they move as wholes.  A shard that can take less than a
SLACK-th of those who wish to come is closed in the next round to groups that need one shard only, which then leave it
for another one.  Labels are settled after two rounds in a row that move less than a SETTLED-th of all linked documents or
don't raise the sum of squared group parts, which grows as members come together; as it is bounded, that happens.

As members of a group are alike, a round works on one row for each (group, shard) with a count, never on documents, so a
group of any share of all rows is at most one row per shard; a group larger than a shard's quota fills one shard after
another.  Quotas are floor(n / shards), plus one for the first n mod shards, so counts are at most one apart (the law
``rows``).  Documents without links are of no matter to the cut and fill what is left of each quota exactly.

Groups of more than a HOT-th of all rows, of which there are at most HOT, are broadcast to the rows; others meet them by
a shuffle.  Ranks within a group or shard come from sums over cells of about CELL_ROWS rows, so no task sorts a group.

Defined cases: a null text has no bytes (size 1), is linked to other null or empty texts, and has the CRC of no bytes;
very long texts are hashed where they are read; repeated rows are documents of their own, linked to each other; a null
doc_id is dealt like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import byte_size, forget, prefix_sum, stored

SHARDS = 16
SLACK = 10
SETTLED = 50
#: Groups that hold more than this share of all rows are hot; so there are fewer than HOT of them.
HOT = 10_000
#: Rows of a cell of the prefix sums, on average, and cells at least.
CELL_ROWS = 50_000
LEAST_CELLS = 64


def cells(rows: int) -> int:
    return max(LEAST_CELLS, -(-rows // CELL_ROWS))


def _by_shard(units: DataFrame, shards: int) -> list[int]:
    """Members of each shard: as many numbers as shards come to the driver."""
    return _state(units, shards)[0]


def _state(units: DataFrame, shards: int) -> tuple[list[int], float]:
    """Members of each shard, and the sum of squared parts of groups."""
    got = units.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).collect()
    held = {r["label"]: r["n"] for r in got}
    return [held.get(s, 0) for s in range(shards)], sum(r["squares"] for r in got)


def _lookup(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def _pair(shards: int) -> Column:
    return F.col("label") * shards + F.col("to")


def granted(wishes: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may move from each shard to each: what both directions share, then what fits into the room."""
    shards = len(room)
    out = [[min(wishes[s][t], wishes[t][s]) for t in range(shards)] for s in range(shards)]
    room = list(room)
    moved = True
    while moved:  # a shard that somebody leaves has room for others
        moved = False
        for t in range(shards):
            for s in sorted(range(shards), key=lambda s: out[s][t] - wishes[s][t]):
                if n := min(wishes[s][t] - out[s][t], room[t]):
                    out[s][t] += n
                    room[t] -= n
                    room[s] += n
                    moved = True
    return out


def _changed(units: DataFrame, moves: DataFrame) -> DataFrame:
    """Units after the moves (group, label, to, part)."""
    changes = moves.select("group", "label", (-F.col("part")).alias("n")).unionByName(moves.select("group", F.col("to").alias("label"), F.col("part").alias("n")))
    return stored(units.unionByName(changes).groupBy("group", "label").agg(F.sum("n").alias("n")).where("n > 0"), "shard-units")


def _ranked(moves: DataFrame, shards: int, cell: Column) -> DataFrame:
    return prefix_sum(moves.withColumn("__pair", _pair(shards)), ["__pair"], cell, [F.col("group")], F.col("n"), "__ahead")


def _matrix(moves: DataFrame, shards: int) -> list[list[int]]:
    """Members that want to go from each shard to each: shards x shards numbers."""
    got = {(r["label"], r["to"]): r["n"] for r in moves.groupBy("label", "to").agg(F.sum("n").alias("n")).collect()}
    return [[got.get((s, t), 0) for t in range(shards)] for s in range(shards)]


def propagate(units: DataFrame, quotas: list[int]) -> DataFrame:
    """From the members n of each (group, label), no shard over its quota, the same after all rounds of moves."""
    shards = len(quotas)
    held, most = _state(units, shards)
    linked, room = sum(held), [q - h for q, h in zip(quotas, held, strict=True)]
    closed: set[int] = set()
    turn, idle = 0, 0
    while linked and idle < 2:
        turn += 1
        # The labels to move to, of at most ``shards``: those that hold most of the group, as many as it needs.
        tie = F.xxhash64("group", "label", F.lit(turn))
        best = units.groupBy(F.col("group").alias("__group")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), tie.alias("tie"), F.col("label")))).alias("__labels"), F.sum("n").alias("__all"))
        best = best.where(F.size("__labels") > 1).withColumn("__needs", F.ceil(F.col("__all") / max(quotas)).cast("int"))
        is_open = F.when((F.col("__needs") > 1) | F.lit(not closed), F.col("__labels.label")).otherwise(F.array_except("__labels.label", F.array(*map(F.lit, sorted(closed))).cast("array<int>")))
        best = best.select("__group", F.slice(is_open, F.lit(1), F.col("__needs")).alias("__to")).where(F.size("__to") > 0)
        wishing = units.join(best, F.col("group") == F.col("__group")).where(~F.array_contains("__to", F.col("label")))
        wishing = wishing.withColumn("to", F.element_at("__to", (F.pmod(tie, F.size("__to")) + 1).cast("int")))
        moves = stored(wishing.select("group", "label", "to", "n"), "shard-wishes")
        wishes = _matrix(moves, shards)
        if not any(map(any, wishes)):
            forget(moves)
            if not closed:
                break
            closed, idle = set(), idle + 1
            continue
        grant = granted(wishes, room)
        # Where more wish to move than come back, whole groups of the wanted shard make place, as many as then come.
        lacking = [[wishes[s][t] - grant[s][t] for s in range(shards)] for t in range(shards)]  # from t to s
        filling = _fillers(units, lacking, turn) if any(map(any, lacking)) else None
        if filling is not None:
            filled = _matrix(filling.withColumnRenamed("part", "n"), shards)
            grant = [[grant[s][t] + filled[t][s] for t in range(shards)] for s in range(shards)]
        came = [sum(grant[s][t] for s in range(shards)) for t in range(shards)]
        closed = {t for t in range(shards) if came[t] * SLACK < sum(wishes[s][t] for s in range(shards))}
        idle += 1
        accepted = []
        if any(came):
            # Larger moves first: a cell is a power of two of the size, and within it a slice by the group's hash.
            cell = (63 - F.floor(F.log2(F.col("n").cast("double")))).cast("int") * LEAST_CELLS + F.pmod(F.xxhash64("group"), F.lit(LEAST_CELLS)).cast("int")
            part = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), _lookup([n for line in grant for n in line], _pair(shards)) - F.col("__ahead")))
            taken = _ranked(moves, shards, cell).withColumn("part", part).where("part > 0").select("group", "label", "to", "part")
            accepted = [stored(taken if filling is None else taken.unionByName(filling), "shard-moves")]
            after = _changed(units, accepted[0])
            forget(units)
            units = after
            held, squares = _state(units, shards)
            room = [q - h for q, h in zip(quotas, held, strict=True)]
            if squares > most and sum(came) * SETTLED >= linked:
                most, idle = squares, 0
        for used in (moves, *accepted, *([] if filling is None else [filling])):
            forget(used)
    return units


def _fillers(units: DataFrame, lacking: list[list[int]], turn: int) -> DataFrame:
    """group, label, to and part: whole groups to move from each shard to each, up to as many members as are lacking there."""
    shards = len(lacking)
    whole = units.groupBy("group").agg(F.count(F.lit(1)).alias("__labels"), F.max("label").alias("label"), F.max("n").alias("n")).where("__labels = 1").drop("__labels")
    # a group is offered to one of the shards that lack members, by a hash of the round
    wanted = F.array(*[F.array(*[F.lit(t).cast("int") for t, n in enumerate(line) if n]).cast("array<int>") for line in lacking])
    among = F.element_at(wanted, (F.col("label") + 1).cast("int"))
    chosen = F.try_element_at(among, (F.pmod(F.xxhash64("group", F.lit(turn)), F.size(among)) + 1).cast("int"))
    offered = whole.where(F.size(among) > 0).withColumn("to", chosen)
    ranked = _ranked(offered, shards, F.pmod(F.xxhash64("group", F.lit(-turn)), F.lit(LEAST_CELLS)).cast("int"))
    fits = F.col("__ahead") + F.col("n") <= _lookup([n for line in lacking for n in line], _pair(shards))
    return stored(ranked.where(fits).select("group", "label", "to", F.col("n").alias("part")), "shard-fillers")


def shard(docs: DataFrame, shards: int = SHARDS, hot: int = HOT) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    text = F.coalesce("text", F.lit(""))
    group = F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.crc32(text.cast("binary"))), byte_size("text").cast("string"))
    rows = docs.select("doc_id", (byte_size("text") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), group.alias("group"))
    # a row's place keeps repeated rows apart; the rows are written once, so it stays
    rows = rows.withColumn("spread", F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id())).withColumn("label", F.pmod("spread", F.lit(shards)).cast("int"))
    rows = stored(rows, "shard-rows")
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    # Equal texts, hot ones too, are summed by (group, label) before they are by group.
    units = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    sized = units.groupBy("group").agg(F.sum("n").alias("members"))
    linked = sized.where("members > 1").select(F.col("group").alias("__group"))
    units = stored(units.join(linked, F.col("group") == F.col("__group"), "left_semi"), "shard-units")
    units = propagate(_within(units, quotas), quotas)
    held = _by_shard(units, shards)
    # What each group has where, as one row with at most ``shards`` ranges of its members' ranks.
    ranges = units.withColumn("until", F.sum("n").over(Window.partitionBy("group").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("until", "label"))).alias("ranges"), F.max("until").alias("members"))
    ranges = stored(ranges.withColumnRenamed("group", "__group"), "shard-ranges")
    known = F.col("group") == F.col("__group")
    is_hot = F.col("members") > F.lit(max(1, total // hot))
    large = F.broadcast(ranges.where(is_hot).drop("members"))  # fewer than ``hot`` rows, as each has over a hot-th of all
    cold = rows.drop("label").join(large.select("__group"), known, "left_anti")
    joined = cold.join(ranges.where(~is_hot).drop("members"), known, "left")
    spread = F.pmod(F.col("spread"), F.lit(cells(total)))
    found = F.element_at(F.filter("ranges", lambda r: r["until"] > F.col("rank")), 1)
    place = ["doc_id", "size", "text_crc32", "spread", found["label"].alias("shard")]
    placed = prefix_sum(rows.drop("label").join(large, known), ["group"], spread, [F.col("spread"), F.col("doc_id")], F.lit(1), "rank").select(*place)
    first = F.row_number().over(Window.partitionBy("group").orderBy("spread", "doc_id")) - 1  # of a group that isn't hot
    placed = placed.unionByName(joined.where("ranges is not null").withColumn("rank", first).select(*place))
    # Documents without links, in order of their hash, fill the gaps.
    gaps = [q - h for q, h in zip(quotas, held, strict=True)]
    ends = [sum(gaps[: s + 1]) for s in range(shards)]
    single = joined.where("ranges is null").drop("ranges", "__group").withColumn("one", F.lit(0))
    single = prefix_sum(single, ["one"], spread, [F.col("spread"), F.col("doc_id")], F.lit(1), "rank")
    at = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    placed = stored(placed.unionByName(single.select("doc_id", "size", "text_crc32", "spread", at.cast("int").alias("shard"))), "shard-placed")
    forget(rows)
    # A row's hash is spread again within its shard, whose rows its remainder may have chosen.
    slots = prefix_sum(placed, ["shard"], F.pmod(F.xxhash64("spread"), F.lit(cells(total // shards))), [F.col("spread"), F.col("doc_id")], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _within(units: DataFrame, quotas: list[int]) -> DataFrame:
    """Units of which no shard has more than its quota: where a hash put too many, the rest goes to shards with room."""
    shards = len(quotas)
    held = _by_shard(units, shards)
    over = [max(0, h - q) for h, q in zip(held, quotas, strict=True)]
    if not any(over):
        return units
    room = [max(0, q - h) for h, q in zip(held, quotas, strict=True)]
    ends = [sum(room[: s + 1]) for s in range(shards)]
    starts = [sum(over[:s]) for s in range(shards)]
    ranked = prefix_sum(units.where(_lookup(over, F.col("label")) > 0), ["label"], F.pmod(F.xxhash64("group"), F.lit(LEAST_CELLS)), [F.col("group")], F.col("n"), "__ahead")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), _lookup(over, F.col("label")) - F.col("__ahead")))
    leaving = ranked.withColumn("part", part).where("part > 0").withColumn("__from", _lookup(starts, F.col("label")) + F.col("__ahead"))
    # A leaving part covers [__from, __from + part) of the line of all room; it is cut where a shard's room ends.
    spans = [F.struct(F.lit(s).alias("to"), F.lit(e - r).cast("long").alias("a"), F.lit(e).cast("long").alias("b")) for s, (e, r) in enumerate(zip(ends, room, strict=True)) if r]
    cut = leaving.withColumn("__span", F.explode(F.array(*spans)))
    took = F.least(F.col("__span.b"), F.col("__from") + F.col("part")) - F.greatest(F.col("__span.a"), F.col("__from"))
    cut = stored(cut.withColumn("took", took).where("took > 0").select("group", "label", F.col("__span.to").alias("to"), "took"), "shard-moves")
    changes = cut.select("group", "label", (-F.col("took")).alias("n")).unionByName(cut.select("group", F.col("to").alias("label"), F.col("took").alias("n")))
    return stored(units.unionByName(changes).groupBy("group", "label").agg(F.sum("n").alias("n")).where("n > 0"), "shard-units")
