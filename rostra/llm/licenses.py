"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Text is lower-cased in A-Z and cut into words of letters, digits and all that isn't ASCII.  One automaton holds every
phrase as space-joined words between spaces, so one pass over a whole text finds all places of all phrases, overlapping
ones too; it runs over pieces of about PIECE bytes, each with the words that a phrase could have begun in.

What a text says is put to the parser as expressions.  Phrases that only the word and or or stands between are one
expression of their labels (under the MIT license or Apache license version 2).  After an identifier tag, a licence
expression is read as far as one can go on: identifiers must be known licences or exceptions, so prose ends it.  The
score is the least value of all expressions, as if and joined them.

Defined cases: a null text counts as empty and has no words, places or labels, and the score 0; a malformed expression
yields the identifiers it holds and the value of an unknown licence; very long texts and lines, with any number of tags,
take time in proportion; repeated rows are scanned alike, and equal texts have equal results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and labels that the base scan must report.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, by their wording.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: How freely text under a licence may be used, by the label's first part.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "bsl": 1.0, "0bsd": 1.0, "zlib": 1.0, "x11": 1.0, "postgresql": 1.0, "wtfpl": 1.0, "cc-by": 0.9, "artistic": 0.8, "ofl": 0.8,
    "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cddl": 0.6, "eupl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.5
#: Bytes of text that are searched at a time.
PIECE = 1 << 20
_LONGEST = max(p.count(" ") + 1 for p in [*BASE, *NOTICES, TAG])

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[ \t:]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Place:
    kind: str  # base, notice or tag
    label: str
    word: int  # of its first word, from 0
    length: int  # in words
    before: bytes = b""  # the word before it


@cache
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", Place(kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    made.make_automaton()
    return made


def plain(text: str | None) -> bytes:
    """A text's words in lower case with white space between them."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS)


def places(found: list[bytes]) -> list[Place]:
    """Every place of every phrase among the words, in order of their ends."""
    line = f" {b' '.join(found).decode()} "
    out, counted, at = [], 0, 0
    for end, p in automaton().iter(line):
        start = end + 1 - p.word
        if start >= at:
            counted, at = counted + line.count(" ", at, start), start
            word = counted
        else:
            word = line.count(" ", 0, start)
        out.append(Place(p.kind, p.label, word, p.length, found[word - 1] if word else b""))
    return out


def searched(raw: bytes, size: int = PIECE) -> tuple[int, list[Place]]:
    """How many words there are, and every place of every phrase, piece by piece."""
    n, out, tail, at = 0, [], [], 0
    while at < len(raw):
        end = raw.find(b" ", at + size) if at + size < len(raw) else -1
        some = raw[at : end if end >= 0 else len(raw)].split()
        at = end if end >= 0 else len(raw)
        for p in places(tail + some):
            if p.word + p.length > len(tail):
                out.append(Place(p.kind, p.label, p.word + n - len(tail), p.length, p.before))
        n += len(some)
        tail = (tail + some)[-_LONGEST:]
    return n, out


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the expression in postfix order, or None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether one has just ended
    for t in tokens:
        if t == "(" and not operand:
            held.append(t)
        elif t == ")" and operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif t in _STRENGTH and operand:
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        elif t not in _STRENGTH and t not in "()" and not operand:
            out.append(t)
            operand = True
        else:
            return None
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out if operand else None


def freedom(label: str) -> float:
    """Of the longest known beginning of a label that ends at a hyphen."""
    parts = label.rstrip("+").split("-")
    return next((FREEDOM[k] for n in range(len(parts), 0, -1) if (k := "-".join(parts[:n])) in FREEDOM), UNKNOWN)


def evaluate(tokens: list[str]) -> tuple[list[str], float]:
    """Identifiers of a lower-case expression, exceptions left out, and its freedom.

    or offers the freer side, and binds to the stricter, with lifts a licence half-way to 1.
    """
    order = postfix(tokens)
    if order is None:
        return sorted({t for t in tokens if t not in _STRENGTH and t not in "()" and "exception" not in t}), UNKNOWN
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t not in _STRENGTH:
            stack.append(({t}, freedom(t)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, (x + 1) / 2) if t == "with" else (a | b, max(x, y) if t == "or" else min(x, y)))
    ids, value = stack[0]
    return sorted(ids), value


def known(identifier: str) -> bool:
    """Whether it is that of a licence, or refers to one kept elsewhere."""
    parts = identifier.rstrip("+").split("-")
    return parts[0] == "licenseref" or identifier != "reserved" and any("-".join(parts[:n]) in FREEDOM for n in range(1, len(parts) + 1))


def expression(low: str, at: int) -> list[str]:
    """The longest licence expression that begins at a place of a lower-case text, on its line; an unended one if there is no whole one."""
    tokens: list[str] = []
    depth, operand, whole = 0, False, 0
    while m := _TOKEN.match(low, at):
        t = m[1]
        bare = t.rstrip(".:-")  # a sentence may end here
        if t == "(":
            fits = not operand
            depth += fits
        elif t == ")":
            fits = operand and depth > 0
            depth -= fits
        elif t in _STRENGTH:
            fits = operand
            operand = False
        else:
            fits = not operand and ("exception" in bare if tokens and tokens[-1] == "with" else known(bare))
            operand = True
        if not fits:
            break
        tokens.append(t if t in "()" else bare)
        at = m.end()
        if operand and not depth:
            whole = len(tokens)
        if t not in "()" and bare != t:
            break
    return tokens[:whole] or tokens


_WORD_AT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tagged(text: str, tags: list[Place]) -> set[tuple[str, ...]]:
    """The different expressions after a text's tags."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    ends = {p.word + p.length - 1 for p in tags}
    return {tuple(expression(low, m.end())) for k, m in enumerate(_WORD_AT.finditer(low)) if k in ends}


def chained(at: list[Place]) -> set[tuple[str, ...]]:
    """The different expressions of phrases that follow each other with and or or between them."""
    out: set[tuple[str, ...]] = set()
    now: list[str] = []
    end = -1
    for p in sorted((p for p in at if p.kind != "tag"), key=lambda p: (p.word, p.length, p.label)):
        if now and p.word == end + 1 and p.before in (b"and", b"or"):
            now += [p.before.decode(), p.label]
        else:
            out |= {tuple(now)} if now else set()
            now = [p.label]
        end = p.word + p.length
    return out | ({tuple(now)} if now else set())


def scan(text: str | None) -> tuple[int, list[Place], list[str], float]:
    """Words, places, all labels and score of a text: the least freedom of all it names, 0 if it names none."""
    n, at = searched(plain(text))
    labels = {p.label for p in at if p.kind != "tag"}
    tags = [p for p in at if p.kind == "tag"]
    values = []
    for e in chained(at) | (tagged(text or "", tags) if tags else set()):
        ids, value = evaluate(list(e))
        if ids:
            labels |= set(ids)
            values.append(value)
    return n, at, sorted(labels), min(values, default=0.0)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (kind, label, word, length), labels and score of every document."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            spans = [[{"kind": p.kind, "label": p.label, "word": p.word, "length": p.length} for p in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, _SPANS), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.float64())],
                ["doc_id", "n_words", "places", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, n_words long, places array<struct<kind:string,label:string,word:long,length:int>>, labels array<string>, score double")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("length", pa.int32())]))
