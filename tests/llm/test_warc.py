import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from rostra.llm import warc as W


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "é word " * (i * 37 % 4000) + "</p>", "h") for i in range(250)]
    rows += [(7, "http://x/7", "<p>again</p>", "h")] * 2 + [(None, None, None, None), (900, "", "", "h"), (901, "u", "long " * 60_000, "h")]
    rows += [(902, "http://x/\r\nContent-Length: 3\r\n\r\n" + "y" * 70_000, "a\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\nb\r\n\r\n", "h"), (None, "http://other", "\r\n\r\n", "h")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, hash string")


def found(first, second):
    return sorted(tuple(r) for r in W.audit(W.tree(first), W.tree(second)).collect())


def test_records_are_laid_out_without_gaps(spark, pages):
    rows = W.records(pages, file_bytes=500_000).collect()
    assert len(rows) == pages.count()
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append((r.offset, r.length))
    assert len(files) > 2
    for x in files.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
    texts = pages.select(W.record_text().alias("t")).collect()
    assert sorted(r.hash for r in rows) == sorted(hashlib.sha256(t.t.encode()).hexdigest() for t in texts)


def test_audit_finds_just_what_differs(spark, pages):
    rows = W.stored(W.records(pages, file_bytes=500_000), "t")
    assert found(rows, rows) == []
    assert W.roots(W.tree(rows)).count() == rows.select("file").distinct().count()
    changed = F.col("page_id").isin(3, 77, 901)
    lost, added = F.coalesce(F.col("page_id"), F.lit(-1)).isin(50, 51, -1), F.col("page_id") == 120
    replica = rows.where(~lost).withColumn("hash", F.when(changed, F.lit("0")).otherwise(F.col("hash")))
    first = rows.where(~F.coalesce(added, F.lit(False)))
    want = [(r.file, r.offset, "changed") for r in rows.where(changed).collect()]
    want += [(r.file, r.offset, "missing") for r in rows.where(lost).collect()] + [(r.file, r.offset, "extra") for r in rows.where(added).collect()]
    assert found(first, replica) == sorted(want)
    status = {(r.file, r.offset): r.status for r in W.audited(first, replica).collect()}
    assert len(status) == first.count() and sum(s != "ok" for s in status.values()) == len(want) - 1


def test_archives_are_read_back_from_their_bytes(spark, pages):
    folder = W.archive(pages, 500_000)
    rows = W.read(spark, folder, text=True).collect()
    want = pages.select("page_id", W.record_text().alias("t")).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.page_id, r.record) for r in rows), key=key) == sorted((tuple(r) for r in want), key=key)
    files = {r.file: W.unpacked(r.content) for r in spark.read.format("binaryFile").load(folder).select("file", "content").collect()}
    assert all(files[r.file][r.offset : r.offset + r.length] == r.record.encode() for r in rows)
    assert sum(map(len, files.values())) == sum(r.length for r in rows)


def test_a_replica_differs_just_where_it_was_changed(spark, pages):
    folder = W.archive(pages, 500_000)
    changed, lost = F.col("page_id").isin("3", "901"), F.coalesce(F.col("page_id").isin("50", "902"), F.lit(True))
    copy = W.replica(spark, folder, F.when(changed, F.replace("record", F.lit("text/html"), F.lit("text/HTML"))).otherwise(F.col("record")), lost)
    first, second = (W.stored(W.read(spark, f), "t") for f in (folder, copy))
    assert second.count() == first.count() - 4
    status = {(r.file, r.offset): (r.page_id, r.status) for r in W.audited(first, second).collect()}
    assert len(status) == first.count()
    assert sorted(((i, s) for i, s in status.values() if s != "ok"), key=str) == [(3, "changed"), (50, "missing"), (901, "changed"), (902, "missing"), (None, "missing"), (None, "missing")]


def test_a_lost_file_and_empty_tables(spark, pages):
    rows = W.stored(W.records(pages, file_bytes=500_000), "t")
    lost = rows.where("file = 0").count()
    assert [s for _, _, s in found(rows, rows.where("file <> 0"))] == ["missing"] * lost
    assert found(rows.limit(0), rows.limit(0)) == [] and W.records(pages.limit(0)).count() == 0


def test_parse(spark, pages):
    texts = [r.t.encode() for r in pages.select(W.record_text().alias("t")).collect()]
    plain = list(W.parse(b"".join(texts)))
    assert [(n, f["content-length"]) for _, n, f, _ in plain] == [(len(t), str(len(b))) for t, (_, _, _, b) in zip(texts, plain, strict=True)]
    packed = [gzip.compress(t) for t in texts[:9]]
    assert [(n, b) for _, n, _, b in W.parse(b"".join(packed))] == [(len(p), b) for p, (_, _, _, b) in zip(packed, plain, strict=False)]
    assert [(n, b) for _, n, _, b in W.parse(b" " * 90 + b"\r\n\r\n" + texts[0] + b"WARC/1.0 broken" + texts[1][:40] + b"\r\n\r\n" + texts[2], holes=True)] == [(len(t), plain[i][3]) for i, t in ((0, texts[0]), (2, texts[2]))]
    for bad in (texts[0][:-3], b"WARC/1.0\r\nContent-Length: x\r\n\r\n", b"HTTP/1.1 200\r\n\r\n", packed[0][:-4]):
        with pytest.raises(ValueError):
            list(W.parse(bad))
