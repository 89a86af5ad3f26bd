"""License notices against an edit-distance search over all windows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens.llm import licenses
from marketlens.llm.licenses import NOTICES, Notice, Search, license_notices
from marketlens.llm.queries import QUERIES

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def least_edits(notice, text):
    """Fewest edits between a notice and any run of whole words, by dynamic programming from every word on."""
    best = None
    for start in [0] + [k + 1 for k, c in enumerate(text) if c == " "]:
        row = list(range(len(notice) + 1))
        for at in range(start, min(len(text), start + 2 * len(notice))):
            new = [row[0] + 1]
            for k, c in enumerate(notice, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != text[at])))
            row = new
            if at + 1 == len(text) or text[at + 1] == " ":
                best = row[-1] if best is None else min(best, row[-1])
    return best


def damaged(notice, edits, rnd):
    text = list(notice)
    for _ in range(edits):
        place, kind = rnd.randrange(len(text)), rnd.random()
        if kind < 0.3:
            text[place] = rnd.choice("abcdez ")
        elif kind < 0.6:
            del text[place]
        else:
            text.insert(place, rnd.choice("abcxyz "))
    return "".join(text)


def test_every_notice_within_its_errors_is_found():
    rnd, search = random.Random(1), Search(NOTICES)
    for _ in range(150):
        notice = rnd.choice(NOTICES)
        around = [" ".join(rnd.choice(["license", "the", "under", "x", "gnu", "mit"]) for _ in range(rnd.randint(0, 6))) for _ in range(2)]
        text = " ".join(f"{around[0]} {damaged(notice.words, rnd.randint(0, notice.errors + 1), rnd)} {around[1]}".split())
        got = {}
        for start, end, k, edits in search.spans(text):
            assert least_edits(NOTICES[k].words, text[start:end]) <= edits <= NOTICES[k].errors
            got[k] = min(edits, got.get(k, edits))
        want = {k: least_edits(n.words, text) for k, n in enumerate(NOTICES)}
        assert got == {k: e for k, e in want.items() if e is not None and e <= NOTICES[k].errors}


def test_pieces_cover_a_notice():
    for notice in NOTICES:
        parts = licenses.pieces(notice)
        assert len(parts) == notice.errors + 1 and "".join(p for _, p in parts) == notice.words and all(p for _, p in parts)
    with pytest.raises(ValueError, match="more errors"):
        Search([Notice("x", "ab", 2)])


ODD = [
    (None, "Released under the MIT License. No id."),
    (1, None),
    (2, ""),
    (3, " \n.,;- "),
    (4, "MIT\nLICENSE, mit-license; Mit  License é mit License"),
    (4, "MIT\nLICENSE, mit-license; Mit  License é mit License"),
    (5, "mit licenses and limit license, mitlicense; mité license"),
    (6, "Licenced under the Apache Licence, Version 2.0"),
    (7, "é" * 5 + " GNU General Public License v3 " + "word " * 200_000 + "general public license"),
    (8, "x" * 1_000_000 + " general public licence"),
    (9, "license " * 2000),
    (10, "Licensed under CC BY-NC 4.0, not CC BY 4.0"),
    (11, "Permission is hereby granted, free of charge, to any perzon obtaining a coppy"),
]


def test_odd_texts_and_base(spark):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({"label": F.lit(1), "labels": F.lit("x"), "score": F.lit(2)})
    found = license_notices(docs).collect()
    assert len(found) == len(ODD)
    by_id = {r.doc_id: r for r in found}
    for doc_id, text in ODD:
        words = WORDS.findall(lower(text or ""))
        places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = by_id[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and r.labels == ",".join(sorted({s.label for s in r.spans}))
        for s in r.spans:
            seen = " ".join(WORDS.findall(lower(text[s.start : s.end])))
            assert least_edits(s.notice, seen) <= s.edits and text[s.start].strip() and text[s.end - 1].strip()
    assert by_id[6].labels == "apache" and by_id[6].n_base == 0 and 0.9 < by_id[6].score < 1
    assert by_id[10].labels == "cc-by-nc,cc-by-nd" and by_id[11].labels == "mit" and by_id[8].labels == "" and by_id[4].score == 1


def test_empty_table_and_own_notices(spark):
    assert license_notices(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(1, "all rights reservd")], "doc_id int, text string")
    assert license_notices(docs, [Notice("own", "all rights reserved", 1)]).first().labels == "own"


def test_query_covers_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in QUERIES["op12_fuzzy_license_notices"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = WORDS.findall(lower(r.text or ""))
        text = " ".join(words)
        assert found[r.doc_id].n_words == len(words)
        # The table search is slow: short texts, and those that name a license.
        if len(text) < 300 or "licen" in text and len(text) < 900:
            want = {n.label for n in NOTICES if (e := least_edits(n.words, text)) is not None and e <= n.errors}
            assert found[r.doc_id].labels == ",".join(sorted(want))
