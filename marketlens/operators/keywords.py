"""Keyword frequencies in review texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions.text import HANGUL_WORD, LATIN_WORD, word_rows
from marketlens.operators.products import BY_CATEGORY
from marketlens.operators.selection import product_lookup
from marketlens.session import materialise

#: Rows of a lookup that may be sent to all tasks, a few short values each; with more, both sides are shuffled.
SENT_PRODUCTS = 2_000_000

#: Bytes of texts whose words a task adds up at a time.
PIECE = 1 << 24

#: Sums of a run of letters in a group, and bytes of such runs, that a task holds before it passes them on; rows it passes on at a time.
HELD, HELD_BYTES, BATCH = 1 << 23, 1 << 26, 1 << 18

#: Bytes with Latin letters in lower case and all other ASCII blank; ASCII_LOWER blanks every byte that is not a Latin letter.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
ASCII_LOWER = bytes(b if b < 128 else 32 for b in LOWER)

#: First bytes of the Hangul syllables in UTF-8, and of some other letters.
HANGUL_LEADS = [bytes([b]) for b in range(0xEA, 0xEE)]


def sent(rows: DataFrame) -> DataFrame:
    """A stored table with the hint for a join: to all tasks up to SENT_PRODUCTS rows, else by a hash of the keys."""
    return F.broadcast(rows) if rows.count() <= SENT_PRODUCTS else rows.hint("shuffle_hash")


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What stands between blanks and signs of ASCII, in lower case, and how many such runs each text has. No word goes beyond a run.

    Where no byte can begin a Hangul syllable, runs are Latin letters only; else they keep whatever is not ASCII.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]])
    raw = raw.translate(LOWER if any(lead in raw for lead in HANGUL_LEADS) else ASCII_LOWER)
    blanked = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(raw)])
    split = pc.ascii_split_whitespace(blanked)
    return split.values, np.diff(split.offsets.to_numpy())


def counted(rows: pa.Table, number: dict[tuple, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct runs, pairs of a run's place among them and its group's number, and how often each pair occurs; new groups are numbered."""
    *keys, texts = rows.combine_chunks().to_batches()[0].columns
    group = np.array([number.setdefault(key, len(number)) for key in zip(*(k.to_pylist() for k in keys))], np.int64)
    found, n = runs(texts)
    found = found.dictionary_encode()
    return found.dictionary, *np.unique(found.indices.to_numpy().astype(np.int64) << 32 | np.repeat(group, n), return_counts=True)


def merged(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Several results of ``counted`` as one, equal runs and pairs once."""
    if len(held) == 1:
        return held[0]
    every = pa.concat_arrays([words for words, _, _ in held]).dictionary_encode()
    place, begin = every.indices.to_numpy().astype(np.int64) << 32, np.cumsum([0] + [len(words) for words, _, _ in held])
    pairs = np.concatenate([place[b:][pairs >> 32] | pairs & 0xFFFFFFFF for b, (_, pairs, _) in zip(begin, held)])
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return every.dictionary, pairs[first], np.add.reduceat(np.concatenate([n for _, _, n in held])[order], first) if len(pairs) else pairs


def spelled(found: pa.Array, pairs: np.ndarray, counts: np.ndarray, number: dict[tuple, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Keys, word and count of pairs of a run and a group; ``schema`` has the keys and the text."""
    run, group = pairs >> 32, pairs & 0xFFFFFFFF
    # A run of ASCII is a word unless it is too short; any other is searched as the text would be.
    plain = pc.string_is_ascii(found).to_numpy(zero_copy_only=False)
    word = plain & (pc.binary_length(found).to_numpy(zero_copy_only=False) > 1)
    pattern = re.compile(f"{HANGUL_WORD}|{LATIN_WORD}")
    others = found.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()
    searched = [pattern.findall(x.decode("utf-8", "replace")) for x in others]
    size = word.astype(np.int64)
    size[~plain] = [len(x) for x in searched]
    place = np.cumsum(word) - 1
    place[~plain] = word.sum() + np.cumsum(size[~plain]) - size[~plain]
    words = pa.concat_arrays([found.filter(pa.array(word)), pa.array([w for x in searched for w in x], pa.string())])
    each = size[run]
    place = np.repeat(place[run] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    group, counts = np.repeat(group, each), np.repeat(counts, each)
    keys = [pa.array([key[i] for key in number], field.type) for i, field in enumerate(list(schema)[:-1])]
    for k in range(0, len(place), BATCH):
        columns = [c.take(pa.array(group[k : k + BATCH])) for c in keys]
        columns += [words.take(pa.array(place[k : k + BATCH])), pa.array(counts[k : k + BATCH])]
        yield pa.RecordBatch.from_arrays(columns, names=[*schema.names[:-1], "word", "n"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows whose last column, a text, has about PIECE bytes in all; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        upto = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff((upto[1:] - upto[0]) // PIECE)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            size += upto[b] - upto[a]
            if size >= PIECE:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def many(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], part: int) -> bool:
    """Whether a task holds the given part of what it may."""
    return sum(len(pairs) for _, pairs, _ in held) >= HELD // part or sum(words.nbytes for words, _, _ in held) >= HELD_BYTES // part


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys and a text as rows of keys, word and count, counted over PIECE bytes of texts at a time and added up over as many as HELD and HELD_BYTES allow."""
    held, number, schema = [], {}, None
    for rows in pieces(batches):
        schema = rows.schema
        held.append(counted(rows, number))
        if many(held, 1):
            held = [merged(held)]
            # Where merging saves less than half there is no use in holding on.
            if many(held, 2):
                yield from spelled(*held[0], number, schema)
                held, number = [], {}
    if held:
        yield from spelled(*merged(held), number, schema)


def words_of_groups(reviews: DataFrame, lookup: DataFrame, keys=BY_CATEGORY, text: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """Counts per group and word; ``lookup`` has one row per group and product.

    Groups and their words are far fewer than products and theirs: repeats are added up where texts are read, and what a
    task holds or shuffles is bounded by the words of all groups. The lookup is counted, and sent to all tasks up to
    SENT_PRODUCTS. Beyond that texts meet it by a hash of the product, without a sort, where the skew-join rule splits
    a product with a third of all reviews. Words are found and added up in Arrow batches, over as many texts as a bounded number
    of sums allows, so that Spark adds up sums and not single words. ``only``, a stored table of distinct words with some of the keys,
    leaves out all others.
    """
    text = F.col("review_text") if text is None else text
    placed = reviews.select("product_id", text.alias("review_text")).join(sent(materialise(lookup.select(*keys, "product_id"), "lookup")), "product_id")
    if only is not None:
        return word_rows(placed, list(keys), F.col("review_text")).join(sent(only), only.columns).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    texts = placed.select(*keys, F.col("review_text").cast("binary")).filter(F.col("review_text").isNotNull())
    schema = T.StructType([*(texts.schema[k] for k in keys), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return texts.mapInArrow(added_up, schema).groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def keyword_counts(reviews: DataFrame, products: DataFrame, keys=BY_CATEGORY) -> DataFrame:
    """Words of reviews whose product has a brand."""
    lookup = product_lookup(products, keys).filter(F.col("brand").isNotNull()).drop("brand")
    return words_of_groups(reviews.filter(F.col("review_text").isNotNull()), lookup, keys)
