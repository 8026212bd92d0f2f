import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import licenses as L


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), sorted((i, x) for p, x in L.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


PIECES = ["Under the MIT", "under", "the", "mit license", "License", "cc by", "BY-NC", "nc", "CC", "apache license,", "version 2", ".0", "é", "\n", "x\x00y", "\x85", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).flatmap(lambda x: st.tuples(st.just(x), st.sampled_from([" ", "-", "", "\xa0"]))))
def test_base_places_match_brute_force(x):
    text = x[1].join(x[0])
    n, at, labels, score = L.scan(text)
    assert (n, sorted((p.word, p.label) for p in at if p.kind == "base")) == brute(text)
    assert {p.label for p in at if p.kind == "base"} <= set(labels) and 0 <= score <= 1


def test_overlapping_places_are_all_found():
    n, at, _, _ = L.scan("cc by nc cc by nc under the mit license under the mit license")
    assert [p.word for p in at if p.kind == "base"] == [0, 3, 6, 10]


def test_expressions():
    value = lambda e: L.evaluate(e.replace("(", "( ").replace(")", " )").split())
    assert value("mit or gpl-3.0-only") == (["gpl-3.0-only", "mit"], 1.0)
    assert value("mit and gpl-3.0-only")[1] == 0.4
    assert value("gpl-2 with classpath-exception") == (["gpl-2"], 0.7)
    assert value("(mit or gpl-2) and apache-2.0")[1] == 1.0
    assert value("mit or gpl-2 and reserved")[1] == 1.0  # and binds tighter than or
    assert value("(mit or") == (["mit"], L.UNKNOWN)
    assert L.postfix(["a", "or", "b", "and", "c"]) == ["a", "b", "c", "and", "or"]


def recursive(tokens):
    """Value of an expression by recursive descent, or None if it is malformed."""
    at = 0

    def level(ops):
        nonlocal at
        if not ops:
            if at < len(tokens) and tokens[at] == "(":
                at += 1
                x = level([["or"], ["and"], ["with"]])
                if at >= len(tokens) or tokens[at] != ")":
                    raise ValueError
                at += 1
                return x
            if at >= len(tokens) or tokens[at] in ("and", "or", "with", ")"):
                raise ValueError
            at += 1
            return L.freedom(tokens[at - 1])
        x = level(ops[1:])
        while at < len(tokens) and tokens[at] in ops[0]:
            op = tokens[at]
            at += 1
            y = level(ops[1:])
            x = {"or": max(x, y), "and": min(x, y), "with": (x + 1) / 2}[op]
        return x

    try:
        x = level([["or"], ["and"], ["with"]])
    except ValueError:
        return None
    return x if at == len(tokens) else None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["mit", "gpl-3.0", "cc-by-nc-4.0", "licenseref-x", "or", "and", "with", "(", ")"]), min_size=1, max_size=9))
def test_expressions_match_recursive_descent(tokens):
    want = recursive(tokens)
    assert (L.postfix(tokens) is None) == (want is None)
    assert want is None or L.evaluate(tokens)[1] == want


def test_tag_is_read_from_its_line():
    scan = lambda t: L.scan(t)[2:]
    assert scan("// SPDX-License-Identifier: (MIT OR GPL-2)\nmore words") == (["gpl-2", "mit"], 1.0)
    assert scan("SPDX-License-Identifier: MIT and then the code goes on here") == (["mit"], 1.0)
    assert scan("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0. It is so.") == (["gpl-2.0-only"], 0.7)
    assert scan("SPDX-License-Identifier: nothing\nMIT") == ([], 0.0)
    assert scan("SPDX-License-Identifier: (MIT or\nGPL-2.0)") == (["mit"], L.UNKNOWN)
    assert scan("SPDX-License-Identifier:\tLicenseRef-own AND Zlib") == (["licenseref-own", "zlib"], L.UNKNOWN)


def test_phrases_joined_by_words_are_expressions():
    scan = lambda t: L.scan(t)[2:]
    assert scan("Under the MIT license or CC BY-NC") == (["cc-by-nc", "mit"], 1.0)
    assert scan("Under the MIT license and CC BY-NC") == (["cc-by-nc", "mit"], 0.1)
    assert scan("Under the MIT license. CC BY-NC") == (["cc-by-nc", "mit"], 0.1)
    assert scan("CC BY-NC or Apache license version 2 and all rights reserved") == (["apache-2", "cc-by-nc", "reserved"], 0.1)


def labels_and_score(text):
    """By search for each phrase, and recursive descent over runs of phrases; texts without tags."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, len(p.split()), x) for p, x in [*L.BASE.items(), *L.NOTICES.items()] for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    runs = []
    for k, (i, n, x) in enumerate(at):
        joined = k and sum(at[k - 1][:2]) + 1 == i and w[i - 1] in ("and", "or")
        runs = [*runs[:-1], [*runs[-1], w[i - 1], x]] if joined else [*runs, [x]]
    return sorted({x for _, _, x in at}), min((recursive(r) for r in runs), default=0.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["under the MIT license", "cc by-nc", "all rights reserved", "Eclipse Public License", "and", "or", "x", "cc0", "by", "license"]), max_size=12))
def test_labels_and_score_match_brute_force(parts):
    text = " ".join(parts)
    assert L.scan(text)[2:] == labels_and_score(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 40))
def test_pieces_find_what_the_whole_text_has(parts, size):
    raw = L.plain(" ".join(parts))
    key = lambda x: (x[0], sorted((p.word, p.label, p.kind, p.length, p.before) for p in x[1]))
    assert key(L.searched(raw, size)) == key(L.searched(raw))


def test_many_tags_take_time_in_proportion():
    import time

    text = "SPDX-License-Identifier: MIT OR GPL-2.0-only " * 40_000
    start = time.perf_counter()
    n, at, labels, score = L.scan(text)
    assert (len(at), labels, score) == (40_000, ["gpl-2.0-only", "mit"], 1.0) and time.perf_counter() - start < 20


def test_query_over_odd_rows(spark):
    rows = [(1, None, "en"), (1, None, "en"), (2, "", None), (None, "cc by nc " * 3000, "x")]
    out = L.licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.places)) for r in out) == [(0, 9000, 3000), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert L.licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").limit(0)).count() == 0
