import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path())


def brute(lengths, capacity):
    bins = []
    for s in lengths:
        def total(b):
            left = [x - s * (i == b) for i, x in enumerate([*bins, capacity])]
            return sum(left[: len(bins) + (b == len(bins))].count(g) ** 2 for g in set(left) if g)
        best = min((total(b), b == len(bins), x - s if b < len(bins) else 0, b) for b, x in enumerate([*bins, capacity]) if x >= s)
        b = best[3]
        bins = [*bins, capacity] if b == len(bins) else bins
        bins[b] -= s
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=30))
def test_each_step_minimises_the_sum_of_squares(lengths):
    where, offset = P.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    used = defaultdict(list)
    for s, b, o in zip(lengths, where, offset, strict=True):
        used[b].append((o, s))
    for x in used.values():
        at = 0
        for o, s in sorted(x):
            assert o == at
            at += s
        assert at <= 20
    assert len(used) <= len(brute(lengths, 20)) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "Word,", "end.", "it's", "'s", "ñandú.", "é", "É", "a.b", "...", "\t", "x y", "###", "12,", "a<|endoftext|>,", "it'...", "b**'", "<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "x<|startoftext|>Y", "<|", "|>", "ΑΣ", "İ", "\x85", "\x0b", "\r\n", "日本", "🙂."]), max_size=20), st.sampled_from([" ", "\n", "  ", ""]))
def test_word_cache_gives_the_tokenizer_s_ids(parts, glue):
    from tokenizers import Tokenizer

    text = glue.join(parts)
    want = Tokenizer.from_file(P.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert P.words(P.tokenizer_path()).encode([text.encode()])[0].tolist() == want


def test_packing_is_whole_and_tight(spark, tokenizer):
    texts = {1: "some words here. " * 900, 2: None, 3: "", 4: "a b c", 5: "x " * 3000}
    rows = [(i, t, 0) for i, t in texts.items()] + [(4, "a b c", 0), (None, "null id", 0)] + [(100 + i, "word " * (i % 40 + 1), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    out = P.best_fit(docs).collect()
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    cut = sorted((i or 0, s // 2048, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for i, xs in want.items() for x in xs for s in range(0, len(x), 2048))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == cut
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for x in used.values():
        assert [o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048
    assert len(used) <= -(-sum(r.length for r in out) // 2048) + 1
    assert P.best_fit(docs.limit(0)).count() == 0
    made = P.sequences(docs).collect()
    assert len(made) == len(used) and sum(len(r.ids) for r in made) == sum(r.length for r in out)


def test_ids_keep_their_digits_beside_null(spark):
    ids = [None, (1 << 60) + 1, (1 << 60) + 3, -(1 << 62) - 1]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in P.best_fit(docs).collect()) == sorted(i or 0 for i in ids)


def test_equal_rows_are_spread_over_the_blocks(spark):
    pieces = spark.range(100_000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "300L as length", "5L as ids_crc32")
    out = P.pack(pieces, 100_000, block=2_000).selectExpr("sequence_id >> 32 as block", "sequence_id", "length")
    blocks = [r["count"] for r in out.groupBy("block").count().collect()]
    assert sum(blocks) == 100_000 and max(blocks) < 4_000
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert out.select("sequence_id").distinct().count() <= -(-100_000 // 6) + len(blocks)
