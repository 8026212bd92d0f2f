"""WARC archives and their Merkle fixity audit.

``archive`` writes pages as WARC records to gzipped files of about FILE_BYTES (before compression) in the shared folder;
``parse`` reads the bytes of a WARC file, plain or gzipped, and ``read`` all files of an archive: records' places, ids
and SHA-256, from the stored bytes.  ``replica`` writes another archive from one's bytes, with changes.  A tree over a
file has the SHA-256 of each record as leaves, and above them nodes for aligned ranges of offsets: LEAF_RANGE bytes,
then FANOUT times as many at each level, up to one root a file.  A node hashes the offsets and hashes of what begins in
its range, in order, so a missing or added record shows as well as a changed one, and leaves all other ranges comparable.

``audit`` joins the roots of two replicas, and from there on, level by level, only the children of nodes that differ.
It returns the records that are changed, missing in the second replica, or extra there.

A task reads a file whole, so it holds FILE_BYTES, or the longest record if that is longer.  A record's bytes decide
its file and its place there; whole rows that repeat, ids included, are therefore in one file, which must stay below
2 GB compressed.

Defined cases: a null page has an empty body and a null address an empty one; line ends in an address are written as
%0D and %0A; repeated rows are records of their own; a null id is written as null, and read as such; empty tables give
empty archives and results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm.common import shared_dir, stored

FILE_BYTES = 16 << 20
LEAF_RANGE = 64 << 10
FANOUT = 16
#: Levels of ranges: 64 KiB, 1 MiB, 16 MiB, 256 MiB, 4 GiB; the last is a file's root.
LEVELS = 5
#: Tasks that write an archive, at most; each writes its files one after another.
WRITERS = 16_384
#: What ends a record.
END = "\r\n\r\n"
#: Bytes of texts that one batch out of ``read`` holds, beyond which it ends with its record.
BATCH_BYTES = 4 << 20


def record_text() -> Column:
    """A page (page_id, url, html) as one WARC record."""
    body = F.coalesce("html", F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
        body,
        F.lit(END),
    )


def number(digest: Column | str = "hash") -> Column:
    """52 bits that the record's bytes decide, from their hash."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _written(records: DataFrame, name: str) -> str:
    """Write rows (file, record), which already stand by file and place, as a file for each ``file``; the folder."""
    path = f"{shared_dir(records.sparkSession)}/{name}-{uuid.uuid4().hex}"
    text = F.expr(f"left(record, length(record) - {len(END)})")
    packed = {"lineSep": END, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    records.select("file", text.alias("value")).write.partitionBy("file").options(**packed).text(path)
    return path


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> str:
    """The folder of the archive that is written from pages (page_id, url, html)."""
    made = pages.select("page_id", "url", "html").select(record_text().alias("record"))
    total = made.agg(F.coalesce(F.sum(F.octet_length("record").cast("long")), F.lit(0))).first()[0]
    files = max(1, -(-total // file_bytes))
    # The number's low part chooses the file, and all of it the place there.
    dealt = made.withColumn("number", number(F.sha2("record", 256))).withColumn("file", F.pmod("number", F.lit(files)).cast("int"))
    return _written(dealt.repartition(min(files, WRITERS), "file").sortWithinPartitions("file", "number", "record"), "warc-archive")


def read(spark: SparkSession, folder: str, kind: str = "long", text: bool = False) -> DataFrame:
    """page_id (of the type ``kind``), file, offset, length and hash of each record that the archive's bytes hold, and
    the record itself, if asked for.  Offsets and lengths are before compression; bytes that are no record are left out."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "file", "offset", "length", "hash", *(["record"] if text else [])]
        schema = pa.schema([("id", pa.string()), ("file", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("hash", pa.string()), *([("record", pa.binary())] if text else [])])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = unpacked(content.as_py())
                rows, held = [], 0
                for at, length, fields, _ in parse(data, holes=True):
                    page = fields.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">")
                    record = data[at : at + length]
                    rows.append((None if page == "null" else page, file, at, length, hashlib.sha256(record).hexdigest(), *([record] if text else [])))
                    held += length if text else 256
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "content")
    out = files.mapInArrow(parsed, "id string, file int, offset long, length long, hash string" + (", record binary" if text else ""))
    columns = [F.col("id").cast(kind).alias("page_id"), "file", "offset", "length", "hash"]
    return out.select(*columns, *([F.col("record").cast("string").alias("record")] if text else []))


def replica(spark: SparkSession, folder: str, changed: Column, lost: Column) -> str:
    """The folder of a copy of an archive in which some records' ``record`` is another, and others' bytes are blank.

    Changed records must keep their length.  No record leaves its file's task.
    """
    rows = read(spark, folder, "string", True)
    blank = F.concat(F.repeat(F.lit(" "), (F.col("length") - len(END)).cast("int")), F.lit(END))
    rows = rows.select("file", "offset", F.when(lost, blank).otherwise(changed).alias("record"))
    return _written(rows.sortWithinPartitions("file", "offset"), "warc-replica")


def records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, file, offset, length and hash of each page's record in an archive written from them."""
    return read(pages.sparkSession, archive(pages, file_bytes), pages.schema["page_id"].dataType.simpleString())


def tree(leaves: DataFrame) -> list[DataFrame]:
    """From file, offset, length and hash of records: the levels of all trees, leaves (level 0) first.

    Each has file, node (a leaf's offset; else the number of its range), until (its end) and hash.
    """
    level = leaves.select("file", F.col("offset").alias("node"), (F.col("offset") + F.col("length")).alias("until"), "hash")
    levels = [level]
    for k in range(LEVELS):
        width = LEAF_RANGE if k == 0 else FANOUT
        parent = F.floor(F.col("node") / width).cast("long")
        # A range holds at most FANOUT nodes, or as many records as begin in LEAF_RANGE bytes.
        inside = F.array_sort(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy("file", parent.alias("node")).agg(F.max("until").alias("until"), inside.alias("inside"))
        line = F.array_join(F.transform("inside", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"])), ";")
        level = level.select("file", "node", "until", F.sha2(line, 256).alias("hash"))
        levels.append(level)
    return [stored(x, f"merkle-{k}") if k else x for k, x in enumerate(levels)]


def roots(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("file", "hash")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("file").alias("__file"), F.col("node").alias("__node"), F.col("hash").alias("__hash"))
    both = a.join(b, (F.col("file") == F.col("__file")) & (F.col("node") == F.col("__node")), "full_outer")
    status = F.when(F.col("__hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    both = both.where(~F.col("hash").eqNullSafe(F.col("__hash")))
    return both.select(F.coalesce("file", "__file").alias("file"), F.coalesce("node", "__node").alias("node"), status.alias("status"))


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """file, offset and status (changed, missing or extra) of each record in which two replicas' trees differ."""
    found = _differing(first[-1], second[-1])
    for k in range(LEVELS - 1, -1, -1):
        above = stored(found.select(F.col("file").alias("__f"), F.col("node").alias("__n")), f"differ-{k}")
        width = LEAF_RANGE if k == 0 else FANOUT

        def under(level: DataFrame, parents: DataFrame = above, width: int = width) -> DataFrame:
            return level.join(parents, (F.col("file") == F.col("__f")) & (F.floor(F.col("node") / width) == F.col("__n")), "left_semi")

        found = _differing(under(first[k]), under(second[k]))
    return found.select("file", F.col("node").alias("offset"), "status")


def audited(rows: DataFrame, replica: DataFrame) -> DataFrame:
    """The records of ``rows`` with their status against a replica's records (file, offset, length, hash): ok, changed or missing."""
    found = audit(tree(rows), tree(replica)).select(F.col("file").alias("__f"), F.col("offset").alias("__o"), "status")
    joined = rows.join(found, (F.col("file") == F.col("__f")) & (F.col("offset") == F.col("__o")), "left").drop("__f", "__o")
    return joined.withColumn("status", F.coalesce("status", F.lit("ok")))


def unpacked(data: bytes) -> bytes:
    """The bytes of a file without its compression, if it has one."""
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes, holes: bool = False) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length (both in the bytes given), header fields and body of each record of a WARC file.

    Of a gzipped file each member must be one record.  Where the bytes are no WARC record, it raises ValueError, or,
    with ``holes``, goes on at the next header of one.
    """
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            text = member.decompress(data[at:])
            if not member.eof:
                raise ValueError(f"a member ends early at {at}")
            length = len(data) - at - len(member.unused_data)
            fields, body, _ = _record(text, 0)
        else:
            try:
                fields, body, end = _record(data, at)
            except ValueError:
                if not holes:
                    raise
                at = data.find(b"\r\n\r\nWARC/", at) + 4
                if at < 4:
                    return
                continue
            length = end - at
        yield at, length, fields, body
        at += length


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0 or data[at : at + 5] != b"WARC/":
        raise ValueError(f"no record at {at}")
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    start = stop + 4
    end = start + (int(size) if re.fullmatch("[0-9]{1,18}", size) else -1)
    if end < start or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    return fields, data[start:end], end + 4
