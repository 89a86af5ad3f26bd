"""License notices in texts: exact seeds locate places, bounded-error matching verifies them.

A text becomes its words (A-Z lowered; words are runs of ASCII digits, letters and all non-ASCII
characters) joined by one blank. A notice may be hit with up to `errors` edits. Cut into errors + 1
pieces, at least one piece stands in any such hit unchanged, at most `errors` characters away from its
own place (pigeonhole). One automaton finds all pieces of all notices; around each, a window as long as
the longest hit is matched by the regex library with that error bound, from word edge to word edge, and
the best match gives span and edits. Pieces on one diagonal share a window; of overlapping spans of a notice the one with fewest edits stays, then the first.
A notice without errors is one piece, so its places are the exact ones.

Every text is handled whole, in one task, without a shuffle; memory is a slice of rows and their hits.

Defined cases: a null text is empty (no words, no labels, score 0); null ids are kept; repeated rows
give repeated results; a tie between spans goes to the earlier one, labels are distinct and sorted;
only the two named columns are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import texts


class Notice(NamedTuple):
    label: str
    words: str
    errors: int


#: Phrases whose exact places count.
PHRASES = [Notice("mit", "mit license", 0), Notice("apache", "apache license", 0), Notice("gpl", "general public license", 0)]
#: Wording of public license notices, as words.
WORDINGS = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "under the terms of the eclipse public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "licensed under cc0 1 0"),
]
#: Characters of a notice for each edit allowed in it.
CHARACTERS_AN_ERROR = 16
NOTICES = PHRASES + [Notice(label, words, max(1, len(words) // CHARACTERS_AN_ERROR)) for label, words in WORDINGS]

#: Bytes of words, A-Z lowered; every other ASCII byte is a blank.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(128)).lower()) + bytes(range(128, 256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ROWS = 512


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(place, piece) of the errors + 1 parts of nearly equal length."""
    edges = [len(notice.words) * k // (notice.errors + 1) for k in range(notice.errors + 2)]
    return [(a, notice.words[a:b]) for a, b in zip(edges, edges[1:])]


class Search:
    def __init__(self, notices: list[Notice]):
        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?<![^ ])(?=[^ ])(?:{regex.escape(n.words)}){{e<={n.errors}}}(?<=[^ ])(?![^ ])") for n in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            if len(notice.words) <= notice.errors:
                raise ValueError(f"more errors than characters: {notice}")
            for place, piece in pieces(notice):
                places.setdefault(piece, []).append((k, place))
        self.seeds = ahocorasick.Automaton()
        for piece, found in places.items():
            self.seeds.add_word(piece, (len(piece), found))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the windows around its pieces, cut at word edges."""
        diagonals: dict[int, list[int]] = {}
        for last, (length, found) in self.seeds.iter(text):
            for k, place in found:
                diagonals.setdefault(k, []).append(last + 1 - length - place)
        out = {}
        for k, starts in diagonals.items():
            size, errors = len(self.notices[k].words), self.notices[k].errors
            spans = set()
            for start in set(starts):
                first = text.rfind(" ", 0, start - errors + 1) + 1 if start > errors else 0
                last = text.find(" ", min(start + size + errors, len(text)))
                spans.add((first, len(text) if last < 0 else last))
            out[k] = sorted(spans)
        return out

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in a text of words joined by blanks, by start."""
        kept = []
        for k, windows in self.windows(text).items():
            found = set()
            for first, last in windows:
                # The library tries no inserted character at the very place a search begins: begin it at a blank.
                match = self.patterns[k].search(" " + text[first:last])
                if match:
                    found.add((first + match.start() - 1, first + match.end() - 1, sum(match.fuzzy_counts)))
            kept += [(start, end, k, edits) for start, end, edits in _apart(found)]
        return sorted(kept)


def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of each run of overlapping spans, in order of edits and start, those that overlap none kept before."""
    runs: list[list[tuple[int, int, int]]] = []
    end = -1
    for span in sorted(spans):
        if span[0] >= end:
            runs.append([])
        runs[-1].append(span)
        end = max(end, span[1])
    kept = []
    for run in runs:
        some: list[tuple[int, int, int]] = []
        for span in sorted(run, key=lambda x: (x[2], x[0], x[1])):
            if all(span[1] <= a or b <= span[0] for a, b, _ in some):
                some.append(span)
        kept += some
    return kept


SPANS = "array<struct<label:string,notice:string,start:int,end:int,edits:int>>"
_SPAN = pa.list_(
    pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
)


def _row(search: Search, raw: bytes) -> tuple:
    """n_words, n_base, first and last word, base labels, labels, score, spans of one text."""
    words = raw.translate(_WORD_BYTES).split()
    text = b" ".join(words).decode("utf-8", "replace")
    found = search.spans(text)
    if not found:
        return len(words), 0, None, None, "", "", 0.0, []
    places = [m.span() for m in _WORD.finditer(raw.decode("utf-8", "replace"))]
    base, labels, spans, best, at, word = [], set(), [], 0.0, 0, 0
    for start, end, k, edits in found:
        word += text.count(" ", at, start)
        at = start
        notice = search.notices[k]
        labels.add(notice.label)
        best = max(best, 1 - edits / len(notice.words))
        last = word + text.count(" ", start, end)
        spans.append({"label": notice.label, "notice": notice.words, "start": places[word][0], "end": places[last][1], "edits": edits})
        if not notice.errors:
            base.append((word, notice.label))
    return (
        len(words),
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted({label for _, label in base})),
        ",".join(sorted(labels)),
        best,
        spans,
    )


def license_notices(docs: DataFrame, notices: list[Notice] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base (places of notices without errors), first_word and last_word of
    those, base_labels, labels (those of all notices hit), score (the best hit's share of unchanged
    characters, 0 without a hit) and spans (code points of the text, end exclusive)."""
    notices = list(NOTICES if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                some = batch.slice(start, _ROWS)
                rows = list(zip(*(_row(search, raw) for raw in texts(some.column(1)))))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *(pa.array(column, kind) for column, kind in zip(rows, kinds))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        f"base_labels string, labels string, score double, spans {SPANS}",
    )
