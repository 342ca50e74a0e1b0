"""License scans: fuzzy search for short notices in whole texts.

A notice may be found with up to ``errors`` edits of its characters. Cut into
``errors + 1`` pieces, at least one piece of every such place is intact
(pigeonhole), so one Aho-Corasick pass over a text with the pieces of all notices
finds every candidate. Around a piece the ``regex`` library's bounded-error
matching verifies the whole notice and gives its span and number of edits. A notice's
naming words have to be intact, or one licence would pass for another. Base
phrases are notices without edits: their one piece is the phrase itself, as whole
words.

A text is searched as its words (runs of a-z, 0-9 and non-ASCII characters after
lower-casing A-Z) joined by one space, so punctuation and line breaks inside a
notice do not matter. A task holds one batch of texts and the notices.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Fixed values of the query: phrase and label of the base, found exactly.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Usual short notices: text, label, number of character edits allowed.
NOTICES = [
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("licensed under the gnu general public license version 3", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    ("mozilla public license version 2 0", "mpl", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    ("all rights reserved", "all-rights-reserved", 1),
]
#: Words of a notice that tell its licence from others: edits may not touch them.
NAMING = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gnu general",
    "gnu lesser general public license": "lesser",
    "gnu affero general public license": "affero",
    "licensed under cc by nc 4 0": "cc by nc",
    "licensed under cc by sa 4 0": "cc by sa",
    "mozilla public license version 2 0": "mozilla",
}
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or c >= 97 and c < 123 or c >= 128
               else 32 for c in range(256))
MATCH = "struct<label: string, base: boolean, first_word: long, end_word: long, errors: int, score: double, text: string>"


def split_exact(text: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``parts`` pieces as even in length as can be."""
    cuts = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _machine(base: tuple, notices: tuple):
    import ahocorasick
    import regex
    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (text, label, errors, is_base, own) in enumerate(
            [(t, la, 0, True, "") for t, la in base] + [(t, la, e, False, own[0] if own else "") for t, la, e, *own in notices]):
        if is_base:
            seeds.setdefault(f" {text} ", []).append((k, -1))
        else:
            for at, piece in split_exact(text, errors + 1):
                seeds.setdefault(piece, []).append((k, at))
        patterns.append((text, label, errors, is_base, f" {own} " if own else "",
                         regex.compile(f"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={errors}}}")))
    auto = ahocorasick.Automaton()
    for piece, of in seeds.items():
        auto.add_word(piece, (len(piece), of))
    auto.make_automaton()
    return auto, patterns


def find(text: str | None, base: tuple, notices: tuple) -> tuple[int, list[dict]]:
    """Number of words, and the matches of one text in order of place. A notice
    is (text, label, edits) and, if it has any, its naming words."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    auto, patterns = _machine(base, notices)
    norm = " " + b" ".join(words).decode("utf-8", "replace") + " "
    near: dict[int, list[list[int]]] = {}
    for end, (size, of) in auto.iter(norm):
        for k, at in of:
            notice, _, errors, *_ = patterns[k]
            a = max(0, end + 1 - size - at - errors)
            b = min(len(norm), end + 1 - size - at + len(notice) + errors)
            spans = near.setdefault(k, [])
            if not patterns[k][3] and spans and a <= spans[-1][1]:
                spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
            else:
                spans.append([a, b])
    out, last_at, last_word = [], 0, 0
    found = []
    for k, spans in near.items():
        notice, label, errors, is_base, own, pattern = patterns[k]
        for a, b in spans:
            for m in pattern.finditer(norm, a, b):
                if own and own not in f" {m[0].strip()} ":
                    continue
                found.append((m.start(), m.end(), label, is_base, sum(m.fuzzy_counts), len(notice)))
    for a, b, label, is_base, errors, size in sorted(found):
        a += norm[a:b][:1] == " "
        b -= norm[a:b][-1:] == " "
        last_word += norm.count(" ", last_at, a)
        last_at = a
        first = last_word - 1
        out.append({"label": label, "base": is_base, "first_word": first, "end_word": first + norm.count(" ", a, b) + 1,
                    "errors": errors, "score": 1 - errors / size, "text": norm[a:b]})
    return len(words), out


def named() -> list[tuple]:
    """``NOTICES`` with their naming words."""
    return [(*n, NAMING.get(n[0], "")) for n in NOTICES]


def _scan(base: tuple, notices: tuple):
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()),
                               ("end_word", pa.int64()), ("errors", pa.int32()), ("score", pa.float64()),
                               ("text", pa.string())]))

    def run(batches):
        for b in batches:
            found = [find(t.as_py(), base, notices) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([m for _, m in found], kind)], names=["doc_id", "n_words", "matches"])
    return run


def scan(docs: DataFrame, base=None, notices=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, matches`` of every row: label, whether it is a base
    phrase, words (from 0, end excluded), edits, score (1 - edits / length) and
    text of each match, in order of place.

    A null or empty text has no words and no matches. Rows are searched one by
    one, so repeated rows and null ids keep theirs; an empty table gives no rows;
    other columns are ignored."""
    shared_dir(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan(tuple(base or BASE), tuple(notices or named())), f"doc_id long, n_words long, matches array<{MATCH}>")


def digest(scanned: DataFrame) -> DataFrame:
    """One row of counts, places and labels per scanned row."""
    base = F.filter("matches", lambda m: m.base)
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x.label))), ",")
    starts = F.transform(base, lambda m: m.first_word)
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0)).alias("score"))
