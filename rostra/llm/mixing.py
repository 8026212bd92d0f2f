"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the key -ln(u) / weight, with u from a hash of its id and text and weight from its quality, so within
a source the smallest keys are a weighted sample without replacement.  A source whose target is T words and whose size
is S gives T // S complete epochs, then documents in order of their keys until the rest of its target is spent; the
document at the edge is taken if that brings the source nearer to its target.  So a source's part of the mix is told
by two numbers, its epochs and the key of its edge.  They come from sums over key ranges (cells), which tasks
pre-aggregate.  A cell is a 64th of a power of two of the key: whatever the weights, it has less than a hundredth of a
source's rows, as its share of an exponential law is at most (key / 64) exp(-key).  The cell of each source that holds the
edge is cut into FINE equal ones and these summed again; only the rows of one of those are sorted.

Targets: sources share ``share`` of all words by their weights; a target stops at ``most`` times its source's size and
the excess goes to the others by weight, until none is above.

Defined cases: a null text has size 0 and is taken for 0 words; a null source is a source of its own, last in order;
very long texts are counted where they are read; repeated rows (same id, same text) have the same key, are one row of
sums, and are taken alike; empty tables give empty results; other columns are ignored by ``taken`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.llm.common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Characters of mark-up and junk, by which the default quality weighs.
SYMBOLS = "#$%&*|!^~<>={}[]@+"
#: Up to so many sources, their table of edges is broadcast (a few MB); beyond it, joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Key ranges to a power of two, and in the one that holds the edge.
CELLS = 64
FINE = 4096
_BITS = float(1 << 52)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str = "mix") -> Column:
    """A number in (0, 1) that the document's id and text decide: the first 52 bits of an md5."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / _BITS


def text_quality() -> Column:
    """Weight by the text alone: 1 without symbols of mark-up, falling with their share to 0.1."""
    n = F.length("text")
    symbols = n - F.length(F.translate("text", SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 5.0 * (symbols.cast("double") / F.when(n > 0, n))), F.lit(1.0))


def sampling_key(weight: Column | None = None) -> Column:
    return -F.log(uniform()) / (text_quality() if weight is None else weight)


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From source and source_size, a row for each source, add weight and target.

    With the sources in order of most * size / weight, the capped ones come first; a source is capped if its cap is
    below the share it would get after those before it.  The windows run over one row per source.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("__cap", F.col("source_size") * float(most))
    everything = Window.partitionBy(F.lit(0))
    line = everything.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    shared = ranked.withColumn("__all", F.sum("source_size").over(everything) * share).withColumn("__weights", F.sum("weight").over(everything))
    shared = shared.withColumn("__rate", (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.col("__weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    shared = shared.withColumn("__free", F.col("__cap") > F.col("weight") * F.col("__rate"))
    rate = F.max(F.when(F.col("__free"), F.col("__rate"))).over(everything)  # the first free one's; it falls after that
    target = F.when(F.col("__free"), F.col("weight") * rate).otherwise(F.col("__cap"))
    return shared.withColumn("target", target).select("source", "source_size", "weight", "target")


def _parted(sums: DataFrame, cell: str) -> tuple[DataFrame, DataFrame]:
    """From source, cell, total, last, before (what lies ahead of all these cells) and rest: source and key of the last
    row of each cell that fits into the rest, and the cell of each source that holds the edge, with what is before it."""
    ahead = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    end = F.col("before") + F.col("total")
    whole = placed.where(end <= F.col("rest")).select("source", F.col("last").alias("key"))
    return whole, placed.where((F.col("before") < F.col("rest")) & (end > F.col("rest")))


def edges(rows: DataFrame, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From source, size and key of each document: per source its source_size, target, epochs and edge.

    A document is taken ``epochs`` times, and once more if its key is at most the edge (null: none is).
    """
    power = F.floor(F.log2("key") * CELLS)
    keyed = rows.withColumn("cell", power.cast("int"))
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("total"), F.max("key").alias("last"))
    goal = targets(cells.groupBy("source").agg(F.sum("total").cast("long").alias("source_size")), share, weights, most)
    size = F.col("source_size")
    goal = goal.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * size)
    g = goal.select(F.col("source").alias("__source"), "rest")
    placed = cells.withColumn("before", F.lit(0)).join(g, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole, cut = _parted(placed, "cell")
    at = cut.select(F.col("source").alias("__source"), F.col("cell").alias("__cell"), "before", "rest")
    inside = keyed.join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.col("cell") == F.col("__cell"))).drop("__source", "__cell")
    start = F.pow(F.lit(2.0), F.col("cell") / CELLS)
    fine = F.floor((F.col("key") / start - 1) / (2 ** (1 / CELLS) - 1) * FINE)
    inside = inside.withColumn("fine", F.greatest(F.lit(0), F.least(F.lit(FINE - 1), fine)).cast("int"))
    sums = inside.groupBy("source", "fine").agg(F.sum("size").alias("total"), F.max("key").alias("last"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    finely, cut = _parted(sums, "fine")
    at = cut.select(F.col("source").alias("__source"), F.col("fine").alias("__fine"), F.col("before").alias("__before"))
    inside = inside.join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.col("fine") == F.col("__fine")))
    inside = inside.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("__before").alias("before"), F.first("rest").alias("rest"))
    until = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("end", F.col("before") + until).where(F.col("end") - F.col("size") / 2 <= F.col("rest")).select("source", "key")
    whole = whole.unionByName(finely)
    edge = whole.unionByName(inside).groupBy(F.col("source").alias("__source")).agg(F.max("key").alias("edge"))
    return goal.join(edge, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "source_size", "target", "epochs", "edge")


def with_times(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Add source_size, target and __times to rows with source and __key."""
    e = edge.select(F.col("source").alias("__source"), "source_size", "target", "epochs", "edge")
    e = F.broadcast(e) if edge.count() <= BROADCAST_SOURCES else e
    more = F.coalesce((F.col("__key") <= F.col("edge")).cast("long"), F.lit(0))
    return rows.join(e, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__times", F.col("epochs") + more).drop("__source", "epochs", "edge")


def taken(docs: DataFrame, weight: Column | None = None, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    rows = stored(docs.select("doc_id", "source", n_words().alias("size"), sampling_key(weight).alias("key")), "mix")
    edge = stored(edges(rows.select("source", "size", "key"), share, weights, most), "mix-edges")
    out = with_times(rows.withColumnRenamed("key", "__key"), edge)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: rows of docs, each as often as it is taken.  No text is shuffled."""
    rows = docs.select("source", n_words().alias("size"), sampling_key(weight).alias("key"))
    edge = stored(edges(stored(rows, "mix"), share, weights, most), "mix-edges").select("source", F.lit(0).alias("source_size"), F.lit(0.0).alias("target"), "epochs", "edge")
    columns = docs.columns
    out = with_times(docs.select(F.struct(*columns).alias("__row"), "source", sampling_key(weight).alias("__key")), edge)
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("__times") > 0, F.col("__times")))).alias("__copy")).select("__row.*")
