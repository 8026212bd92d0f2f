"""Helpers that the operators share: reading tables, cutting lineage, and a prefix sum without a single hot task."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that the word rules split at: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the session names none, a local one is made if all runs in one process
    (tests); on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='rostra-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later reads survive a lost executor and don't recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give memory that this process has freed back to the system: Python workers are used again, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with a trim after each and at their end."""
    for batch in batches:
        yield batch
        del batch
        trim()
    trim()


def trim_driver(spark: SparkSession, command: str = "systemTrimNativeHeap") -> bool:
    """The same for the driver, its Python and its JVM, whose compilers and many threads free what malloc then keeps;
    whether its JVM can do that (Java 17.0.9 on Linux)."""
    trim()
    jvm = spark._jvm
    try:
        # The server's class is hidden from py4j, the interface's method isn't.
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")
        (invoke,) = [m for m in kind.getMethods() if m.getName() == "invoke"]
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = command
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def byte_size(column: str) -> Column:
    """UTF-8 bytes of a string column; null counts as empty."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def prefix_sum(df: DataFrame, part: Sequence[str], cell: Column, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the same ``part``.

    Rows are ordered by (cell, *order).  A first pass sums each cell, a window over those sums gives each cell's
    offset, and only within a cell are rows sorted.  So one part may hold any share of the rows: a task sorts a cell.
    Cells must not be null.  Rows that tie in ``order`` should be interchangeable.
    """
    rows = df.withColumn("__cell", cell.cast("int")).withColumn("__value", value.cast("long"))
    keys = [*part, "__cell"]
    ahead = Window.partitionBy(*part).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    cells = cells.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(part)], F.col("__cell").alias("__c"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    on = F.col("__cell") == F.col("__c")
    for i, p in enumerate(part):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return summed.join(cells, on).withColumn(name, F.col("__offset") + F.col("__within")).drop("__cell", "__value", "__within", "__c", "__offset", *[f"__p{i}" for i in range(len(part))])
